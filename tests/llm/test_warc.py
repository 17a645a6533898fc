import base64
import gzip
import hashlib
import zlib

from pyspark.sql import functions as F

from spindlewatch.llm import warc
from spindlewatch.llm.files import locate
from spindlewatch.shared import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def brute(rows):
    heads = {}
    for i, _, html in rows:
        if i is not None:
            heads[html or ""] = max(heads.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        head = heads.get(html or "")
        again = head is not None and i != head
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def read(spark, files, range_bytes):
    return sorted((tuple(r) for r in warc.read_archives(spark, files, range_bytes).collect()), key=str)


def rows():
    body = "<html>" + "".join(f"<p>paragraph {i} é</p>" for i in range(50))
    made = [(i, f"http://x.example/{i} é\r\n", f"{body}{i % 40}") for i in range(90)]
    # gzip members written as text inside a payload, and a record's own first line
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", mtime=0).decode("latin-1")
    return made + [(200, None, inner), (201, "", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (202, "u", None), (203, "u", ""),
                   (None, "n", body + "3"), (None, "n", "only without ids"), (204, "u", "x"), (204, "u", "x")]


def test_round_trip_with_any_ranges(spark):
    files = warc.write_archives(spark, pages(spark, rows()), file_bytes=3000)
    assert files.agg(F.sum("records")).first()[0] == len(rows())
    for range_bytes in (150, 1 << 20):
        assert read(spark, files, range_bytes) == brute(rows())


def test_members_inside_a_payload_are_no_records(spark):
    """Stored members keep their payload's bytes, so whole records lie inside another."""
    inside = warc._members(warc._record(77, "u", b"inner", hashlib.sha1(b"inner").hexdigest(), None, "response"))
    payload = b"head" + inside + b"between" + inside
    outer = warc._record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None, "response")
    store = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = store.compress(outer) + store.flush()
    data += warc._members(warc._record(2, "u", b"next", hashlib.sha1(b"next").hexdigest(), None, "response"))
    folder = scratch_path(spark, "archive")
    system, path = locate(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/a.warc.gz", compression=None) as out:
        out.write(data)
    files = spark.createDataFrame([(f"{folder}/a.warc.gz", len(data), 2)], "file string, bytes long, records long")
    for range_bytes in (100, 1 << 20):
        assert [r[0] for r in read(spark, files, range_bytes)] == [1, 2]


def test_foreign_records_neither_break_the_chain_nor_the_job(spark):
    own = warc._record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "response")
    head = b"WARC/1.1\r\nWARC-Type: response\r\n"
    body = b"HTTP/1.1 200 OK\r\nContent-Length: chunked\r\n\r\nabc"
    digest = base64.b32encode(hashlib.sha1(b"abc").digest())
    foreign = [
        b"no record at all",
        b"",
        head + b"Content-Length: x\r\n\r\n",
        head + b"Content-Length: -5\r\n\r\n",
        head + b"\r\n",
        head + b"Content-Length: " + b"9" * 30 + b"\r\n\r\n",
        head + b"X: \xe9\xff\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: %d\r\n\r\n" % len(body) + body,
        head.replace(b"response", b"warcinfo") + b"WARC-Record-ID: <urn:x-page:" + b"9" * 19 + b">\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    ]
    data = b"".join(warc._members(r) + warc._members(own) for r in foreign)
    folder = scratch_path(spark, "archive")
    system, path = locate(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/a.warc.gz", compression=None) as out:
        out.write(data)
    files = spark.createDataFrame([(f"{folder}/a.warc.gz", len(data), 2)], "file string, bytes long, records long")
    for range_bytes in (100, 1 << 20):
        found = read(spark, files, range_bytes)
        assert all(r[3] is not None for r in found)
        assert sorted((r[0], r[3]) for r in found if r[0] is not None) == [(1, "response")] * len(foreign) + [(77, "response")]
        assert [r[3] for r in found if r[0] is None] == ["warcinfo"]


def test_the_archives_are_plain_gzip(spark):
    files = warc.write_archives(spark, pages(spark, [(1, "http://a/", "<p>hello</p>"), (2, "http://b/", "<p>hello</p>")]))
    text = b""
    for r in files.collect():
        system, path = locate(r.file)
        with system.open_input_file(path) as f:
            text += gzip.decompress(f.read())
    assert text.count(b"WARC/1.1\r\n") == 2 and text.count(b"WARC-Type: revisit") == 1
    assert b"WARC-Refers-To: <urn:x-page:2>" in text and text.count(b"<p>hello</p>") == 1


def test_small_payloads_empty_tables_and_more_columns(spark):
    df = pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]).selectExpr("*", "1 AS sha1", "2 AS head")
    files = warc.write_archives(spark, df, least=3)
    assert [(r[0], r[3], r[4]) for r in read(spark, files, 1 << 20)] == [
        (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)
    ]
    assert read(spark, warc.write_archives(spark, pages(spark, [])), 100) == []
