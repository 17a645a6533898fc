import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spindlewatch.llm import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def counts_of(rows):
    f = {}
    for lang, text in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in words_of(text):
            for m in range(1, 5):
                own.update(tuple(piece[i : i + m]) for i in range(len(piece) - m + 1))
    return f


def expected(rows, least=30, top=2000):
    out = set()
    for lang, f in counts_of(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        ranked = []
        for p, a in candidates.items():
            inside = any(
                100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items() if len(q) > len(p)
            )
            if not inside:
                score, _, left, rest = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, rest))
        for rank, (score, a, phrase, left, rest) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, rest, n, -score))
    return out


def table(spark, rows, partitions=3):
    full = [(i, t, lang, "src", 1) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)


def found(spark, df, **options):
    out = collocations.collocations(spark, df, **options)
    assert tuple(out.columns) == COLUMNS
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def prose(rng, n):
    vocabulary = ["New", "york", "City", "of", "THE", "a", "Éa", "b-c", "x"]
    text = []
    for _ in range(n):
        text.append(rng.choice(vocabulary) if rng.random() < 0.7 else "new York City")
        text.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]))
    return "".join(text)


def test_chunks_hold_every_phrase_once():
    """Each chunk's phrases that end behind its shared words are together all phrases of the text, for any trigger rate."""
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 2, 3, 4, 5, 40, 300)] + [None, "", " \t\n", "a " * 500, "a. " * 200]
    for period in (1, 2, 5, 1000):
        row, head, parts = collocations.chunks(pa.array(texts), period)
        for r, text in enumerate(texts):
            own = Counter()
            for first, chunk in zip(head[row == r], parts.filter(pa.array(row == r)).to_pylist(), strict=True):
                flat = [(w, i) for i, piece in enumerate(chunk.split("\n")) for w in piece.split(" ")]
                for last in range(0 if first else 3, len(flat)):
                    for m in range(1, min(4, last + 1) + 1):
                        run = flat[last - m + 1 : last + 1]
                        if len({i for _, i in run}) == 1:
                            own[tuple(w for w, _ in run)] += 1
            assert own == counts_of([("x", text)])["x"]


def test_equal_stretches_are_cut_alike():
    rng = random.Random(2)
    middle = " ".join(f"w{rng.randrange(400)}" for _ in range(600))
    _, _, one = collocations.chunks(pa.array(["start here " + middle + " one end"]))
    _, _, two = collocations.chunks(pa.array(["quite another, longer beginning " + middle + " and other end"]))
    assert len(set(one.to_pylist()) & set(two.to_pylist())) >= len(one) - 3


@pytest.mark.parametrize("period", [1, 4, 32])
def test_random_texts_equal_the_definition(spark, period):
    rng = random.Random(period)
    rows = [(rng.choice(["en", "fr", None, "und"]), prose(rng, rng.choice([0, 3, 30, 400]))) for _ in range(60)]
    copied = rows + [rows[7]] * 40
    assert found(spark, table(spark, copied), least=5, period=period) == expected(copied, least=5)


def test_ranks_are_cut_after_a_total_order(spark):
    rng = random.Random(8)
    rows = [("en", prose(rng, 500)) for _ in range(10)]
    assert found(spark, table(spark, rows), least=3, top=7) == expected(rows, least=3, top=7)


def test_a_chunk_in_every_text_and_a_third_of_all_rows_equal(spark):
    rng = random.Random(4)
    line = "All rights reserved by the owner of this line."
    rows = [("en", prose(rng, 60) + "\n" + line + "\n" + prose(rng, 20)) for _ in range(80)] + [("en", "same words here " * 30)] * 40
    assert found(spark, table(spark, rows, 16)) == expected(rows)


def test_nulls_empties_long_texts_and_extra_columns(spark):
    rows = [(None, None), (None, ""), ("en", None), ("", "a b " * 40), ("de", "word " * 100_000), ("fr", "x" * 300_000 + " y z" * 50)]
    df = table(spark, rows).selectExpr("*", "1 AS n", "'p' AS phrase", "2 AS f", "true AS head", "'c' AS chunk")
    assert found(spark, df) == expected(rows)
    assert found(spark, table(spark, rows).limit(0)) == set()


def test_a_full_bitmap_only_costs_time(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("en", prose(rng, 200)) for _ in range(10)] + [("fr", prose(rng, 200))]
    full = np.full(1 << 14, 255, np.uint8)
    monkeypatch.setattr(collocations, "bitmap", lambda spark, hashes: spark.sparkContext.broadcast(full))
    assert found(spark, table(spark, rows), least=4) == expected(rows, least=4)


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_001
    phrases = spark.createDataFrame([("en", "a b", big - 7), ("en", "a b c", 40)], "lang string, phrase string, f long")
    parts = spark.createDataFrame([("en", p, big) for p in ("a", "b", "a b", "b c", "c")], "lang string, phrase string, f long")
    out = {r.phrase: r.score for r in collocations.scored(phrases, parts).collect()}
    assert out == {"a b": 2000000 * (big - 7) // (2 * big), "a b c": 0}


def test_no_hash_is_lost_in_a_bitmap(spark, monkeypatch):
    hashes = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    df = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long")
    for least, most in ((20, 30), (17, 18), (22, 22)):
        monkeypatch.setattr(collocations, "LEAST_BITS", least)
        monkeypatch.setattr(collocations, "MOST_BITS", most)
        bits = collocations.bitmap(spark, df).value
        assert (1 << least) <= 8 * len(bits) <= (1 << most)
        assert collocations.is_set(bits, hashes).all()
        assert np.unpackbits(bits).sum() == len(set((hashes >> np.uint64(64 - len(bits).bit_length() - 2)).tolist()))
