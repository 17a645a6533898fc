"""WARC archives: one gzip member for each record, and a reader that finds the records from anywhere in a file.

Tasks read byte ranges of the archives. Each finds every place in its range that looks like a member, and how far that
member goes: a candidate and its successor. Bytes inside a payload can look like a member, so a candidate counts only
if a chain of successors from the file's start reaches it. Chains are followed within a range by its task; pointer
jumping over the ranges then finds, in a number of rounds that grows with the logarithm of the ranges of a file, at
which candidate the chain enters each range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.files import make_folder, new_file, read_range
from spindlewatch.shared import scratch_path, written

FILE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
_PIECE = 1 << 16

# Fixed values of the formats.
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"

_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, kind: str) -> bytes:
    """A record, with the payload in an HTTP response; a revisit has the response's headers only."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


_NUMBER = re.compile("[0-9]{1,18}")


def parse(data: bytes) -> tuple | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a whole record; None if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        return None
    # Headers are of any origin: bytes that are no UTF-8 are replaced, sizes that are no numbers make no record.
    fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = fields.get(b"content-length", "")
    if not _NUMBER.fullmatch(length):
        return None
    block = rest[: int(length)]
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = (x.partition(b":") for x in http.split(b"\r\n")[1:])
    sizes = (v.strip().decode("ascii", "replace") for k, _, v in sizes if k.strip().lower() == b"content-length")
    size = next((int(v) for v in sizes if _NUMBER.fullmatch(v)), len(payload))
    kind = fields.get(b"warc-type")

    def number(name: bytes) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(_ID)
        return int(text) if re.fullmatch("-?[0-9]{1,19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None

    stated = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else stated
    if kind == "response" and (digest != stated or size != len(payload)):
        return None
    return number(b"warc-record-id"), size, digest, kind, number(b"warc-refers-to")


def _members(record: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            size = records = 0
            with new_file(folder, ".warc.gz") as (uri, stream):
                while row is not None and size < file_bytes:
                    page_id, url, payload, sha1, refers_to, kind = row
                    data = _members(_record(page_id, url, payload, sha1, refers_to, kind))
                    stream.write(data)
                    size += len(data)
                    records += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_pydict({"file": [uri], "bytes": [size], "records": [records]})

    return run


def write_archives(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 0, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the files (file, bytes, records).

    Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is the response and
    the others are revisits of it; rows that share that id and payload are all responses, and so are smaller payloads.
    A null payload is empty. A row without an id revisits a row with one; where none has one, all are responses.
    The payloads are shuffled once, by their digest, where a group of any size can be split over tasks.
    """
    folder = folder or scratch_path(spark, "warc")
    make_folder(folder)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    heads = rows.where(F.length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("head"))
    known = rows.join(heads, "sha1", "left")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    records = known.select(
        "page_id", "url", "payload", "sha1",
        F.when(again, F.col("head")).alias("refers_to"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
    )
    return written(spark, records.mapInArrow(_writer(folder, file_bytes), "file string, bytes long, records long"), "archives")


def _member(uri: str, data: bytes, at: int, start: int) -> tuple[bytes, int] | None:
    """The content and the end of the member at ``at``; ``data`` is the file from ``start`` on, as far as it was read."""
    unpack, out = zlib.decompressobj(31), []
    try:
        place = at - start
        while not unpack.eof:
            piece = data[place : place + _PIECE] if place < len(data) else read_range(uri, start + place, _PIECE)
            if not piece:
                return None
            place += len(piece)
            out.append(unpack.decompress(piece))
    except zlib.error:
        return None
    return b"".join(out), start + place - len(unpack.unused_data)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (file, part, start, stop) to candidates: (file, part, offset, next, out) and the record, if it is one.

    ``out`` is the first offset beyond the range that the chain from the candidate comes to, or null where the chain
    breaks off inside.
    """
    for batch in batches:
        for uri, part, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = read_range(uri, start, stop - start + len(_MAGIC) - 1)
            found = []
            at = data.find(_MAGIC)
            while 0 <= at < stop - start:
                member = _member(uri, data, start + at, start)
                if member:
                    found.append((start + at, member[1], parse(member[0])))
                at = data.find(_MAGIC, at + 1)
            out: dict[int, int | None] = {}
            for offset, after, _ in reversed(found):
                out[offset] = after if after >= stop else out.get(after)
            rows = [(uri, part, o, n, out[o], *(r or (None,) * 5)) for o, n, r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


_CANDIDATE = "file string, part int, offset long, next long, out long, " + _RECORD
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = [x.split(" ")[0] for x in _CANDIDATE.split(", ")]


def _reached(candidates: pa.Table, entries: pa.Table) -> pa.Table:
    """The records of a range on the chain from where it is entered."""
    after = dict(zip(candidates.column("offset").to_pylist(), candidates.column("next").to_pylist(), strict=True))
    row = {o: i for i, o in enumerate(after)}
    keep = []
    for at in sorted(set(entries.column("offset").to_pylist())):
        while at in row:
            keep.append(row.pop(at))
            at = after[at]
    found = candidates.take(pa.array(keep, pa.int64()))
    return found.filter(pc.is_valid(found.column("record_type"))).select([x.split(" ")[0] for x in _RECORD.split(", ")])


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``files`` (file, bytes).

    A response's digest and size are those of the payload that was read; where they differ from what its header says,
    or a member on the chain holds no record, the member is left out. A chain ends where the file is broken.
    """
    part = F.explode(F.sequence(F.lit(0), F.expr(f"int((bytes - 1) div {range_bytes})")))
    ranges = files.where("bytes > 0").select("file", "bytes", part.alias("part")).select(
        "file", "part",
        (F.col("part").cast("long") * range_bytes).alias("start"),
        F.least(F.col("bytes"), (F.col("part").cast("long") + 1) * range_bytes).alias("stop"),
    )
    count, deepest = ranges.agg(F.count("*"), F.max("part")).first()
    ranges = ranges.repartition(max(1, count), "file", "part")
    found = written(spark, ranges.mapInArrow(_candidates, _CANDIDATE), "candidates")
    entered = files.select("file", F.lit(0).cast("long").alias("offset"))
    hops = found.where("out IS NOT NULL").select("file", F.col("offset").alias("at"), "out")
    # After k rounds a hop crosses 2^k ranges, and the entries of the first 2^k ranges are known.
    for _ in range((deepest or 0).bit_length()):
        far = entered.join(hops.withColumnRenamed("at", "offset"), ["file", "offset"]).select("file", F.col("out").alias("offset"))
        entered = written(spark, entered.unionAll(far).distinct(), "entries")
        onward = hops.select("file", F.col("at").alias("out"), F.col("out").alias("beyond"))
        hops = written(spark, hops.join(onward, ["file", "out"]).select("file", "at", F.col("beyond").alias("out")), "hops")
    entered = entered.withColumn("part", F.expr(f"int(offset div {range_bytes})"))
    return found.groupBy("file", "part").cogroup(entered.groupBy("file", "part")).applyInArrow(_reached, _RECORD)
