import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from spindlewatch.llm import substrings


def brute(rows, window=20):
    """The definition, window by window."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = -(1 << 63)
    first = {}
    for i, words in texts:
        for s in range(len(words) - window + 1):
            place = (low if i is None else i, s)
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (low if i is None else i, s):
                gone[s : s + window] = [True] * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), sum(gone), " ".join(kept), [n for n, g in enumerate(gone) if g]))
    return sorted(out, key=str)


def found(spark, df, **options):
    rows = substrings.without_repeats(spark, df, **options).collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, r.kept, [n for s in r.removed for n in range(s.start, s.stop)]) for r in rows), key=str
    )


def corpus(seed):
    rng = random.Random(seed)

    def prose(n):
        return [rng.choice("the of and to Ördnung x été , .") if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(n)]

    passages = [prose(rng.choice([19, 20, 21, 25, 50, 120])) for _ in range(8)]
    rows = []
    for i in range(60):
        words = prose(rng.randrange(0, 150))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i * 7 % 61, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)))
    copies = [(100 + i, rows[3][1]) for i in range(30)]
    edits = []
    for i in range(10):
        words = rows[5][1].split()
        for _ in range(min(2, len(words))):
            words[rng.randrange(len(words))] = f"edit{i}"
        edits.append((200 + i, " ".join(words)))
    return rows + copies + edits


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, documents, seed):
    rows = corpus(seed)
    assert found(spark, documents(rows)) == brute(rows)


def test_many_small_chunks_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 2000)
    rows = corpus(3)
    assert found(spark, documents(rows)) == brute(rows)


def test_periodic_texts(spark, documents):
    rows = [
        (1, "a " * 45), (2, "a " * 21), (3, "a b c " * 15), (4, "x y " + "a b c " * 9 + "z"), (5, "b c a " * 12),
        (6, " ".join(f"p{i % 17}" for i in range(70))), (7, " ".join(f"p{i % 17}" for i in range(5, 60))),
        (8, "a " * 200 + "b " + "a " * 30),
    ]
    assert found(spark, documents(rows)) == brute(rows)


def test_a_periodic_text_alone():
    """Every period and length by itself, by the functions of the chunks, without the rows of other texts."""

    def alone(words):
        docs = pa.table({"doc_id": pa.array([1]), "text": pa.array([" ".join(words)]), "chunk": pa.array([0], pa.int32())})
        anchors = pa.Table.from_batches(substrings._anchors(20)(iter(docs.select(["text", "chunk"]).to_batches())))
        flags = anchors.filter(pc.greater(anchors["n"], 1))
        places = substrings._coordinates(20)(docs, flags) if len(flags) else substrings._COORDINATES.empty_table()
        return substrings._cover(20)(docs, places.filter(pc.greater(places["n"], 1))).column("n_removed")[0].as_py()

    for period in range(1, 17):
        for length in range(20, 62):
            words = [f"q{i % period}" for i in range(length)]
            assert alone(words) == brute([(1, " ".join(words))])[0][2], (period, length)


@pytest.mark.parametrize("period, times, removed", [(7, 6, 35), (15, 3, 30), (1, 30, 29), (10, 4, 30)])
def test_one_row_of_a_repeated_line(spark, documents, period, times, removed):
    rows = [(1, "\n".join([" ".join(f"q{i}" for i in range(period))] * times))]
    got = found(spark, documents(rows))
    assert got == brute(rows) and got[0][2] == removed
    twice = [*rows, (2, rows[0][1])]
    assert found(spark, documents(twice)) == brute(twice)


def test_nulls_repeated_ids_and_short_texts(spark, documents):
    text = " ".join(f"n{i}" for i in range(40))
    rows = [
        (5, text), (5, text), (5, "lead " + text), (None, text + " tail"), (2, None), (3, ""), (4, " \n\t"),
        (6, " ".join(text.split()[:19])), (7, " ".join(text.split()[:20])),
    ]
    assert found(spark, documents(rows)) == brute(rows)
    assert found(spark, documents([])) == []


def test_other_windows_and_clashing_columns(spark, documents):
    rows = corpus(4)[:25]
    docs = documents(rows).selectExpr("*", "1 AS chunk", "'k' AS key", "0 AS n_words", "1 AS word")
    assert found(spark, docs, window=8) == brute(rows, 8)
    assert found(spark, docs, window=3) == brute(rows, 3)


def test_a_very_long_text(spark, documents):
    rng = random.Random(9)
    words = [f"v{rng.randrange(50000)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (0, " ".join(words[1000:1100])), (2, " ".join(words[250_000:250_030]))]
    assert found(spark, documents(rows)) == brute(rows)
