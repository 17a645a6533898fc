import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from spindlewatch.llm import languages, queries
from spindlewatch.llm.words import Words

SF = "/root/testdata/sf0.01"
COLUMNS = ("doc_id", "held_out", "lang_pred", "score")
WORDS = {
    "en": "the of and hill water with house", "de": "der und die haus wasser mit berg", "nl": "de en het huis water met heuvel",
    "fr": "le et la maison eau avec colline", "es": "el y la casa agua con colina", "xx": "zu qua bli floo gnar pix wup",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def made(seed=1, each=60, langs=tuple(WORDS)):
    rng = random.Random(seed)
    rows = [(lang, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(4, 40)))) for lang in langs for _ in range(each)]
    rng.shuffle(rows)
    return [(i, t, lang) for i, (lang, t) in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, f"s{i}", 1) for i, t, lang in rows], SCHEMA).repartition(3)


def features_of(text):
    """Places and values of one text, by definition."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    out = {}
    grams = [data[i : i + 3] for i in range(len(data) - 2) if data[i + 1] != 32]
    words = re.findall(rb"[^ ]+", data)
    for g in grams:
        place = (int.from_bytes(g, "big") * 0x9E3779B1 % 2**32) >> 16
        out[place] = out.get(place, 0) + 20 / len(grams)
    hashes = Words(pa.array([b" ".join(words)], pa.binary()).cast(pa.large_binary()).view(pa.large_string())).hashes()
    for h in hashes:
        place = (int(h) >> 48) + 65536
        out[place] = out.get(place, 0) + 20 / len(words)
    return out


TEXTS = ["The hill, 12 hills", None, "", "a", "ab", "é", "Ünï çødé 12.5%", "x" * 50, "1234 ...", "a b c d", "the\nthe\tthe"]


def test_features_are_those_of_each_text_alone():
    for (places, values), text in zip(languages.Features(pa.array(TEXTS)).sparse(), TEXTS, strict=True):
        own = dict(zip(places.tolist(), values.tolist(), strict=True))
        assert own.pop(languages._SIZE - 1) == 1.0
        assert own == pytest.approx(features_of(text), rel=1e-5)


def test_margins_are_the_sparse_dot_products_and_equal_for_equal_texts():
    weights = np.random.default_rng(0).normal(size=languages._SIZE).astype(np.float32)
    texts = TEXTS * 3
    rows = np.array([i % 5 != 2 for i in range(len(texts))])
    margins = languages.Features(pa.array(texts)).margins(weights, rows)
    expected = [weights[-1] + sum(weights[i] * x for i, x in features_of(t).items()) for t, r in zip(texts, rows, strict=True) if r]
    assert margins == pytest.approx(expected, abs=1e-4)
    by_text = {}
    for t, m in zip([t for t, r in zip(texts, rows, strict=True) if r], margins, strict=True):
        by_text.setdefault(t, set()).add(m)
    assert all(len(m) == 1 for m in by_text.values())


def test_training_comes_near_the_optimum():
    """The primal value, which no weights can take below the dual's, against a plain subgradient descent."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(50, 8, False)).astype(np.int32), rng.random(8).astype(np.float32), int(s)) for s in rng.choice([-1, 1], 80)]
    for place, x, side in rows:
        x[place < 25] *= 1.5 if side > 0 else 0.5
    n = len(rows)
    share = {s: n / (2 * sum(r[2] == s for r in rows)) for s in (1, -1)}

    def primal(w):
        return 0.5 * w @ w + sum(share[s] * max(0.0, 1 - s * (w[p] @ x)) for p, x, s in rows)

    best, w = np.inf, np.zeros(languages._SIZE)
    for step in range(1, 4001):
        slope = w.copy()
        for p, x, s in rows:
            if s * (w[p] @ x) < 1:
                slope[p] -= share[s] * s * x
        w = w - slope / step
        best = min(best, primal(w)) if step % 50 == 0 else best
    assert primal(languages.train(rows, epochs=100)) <= best * 1.01
    assert primal(languages.train(rows)) <= best * 1.05


def test_families_come_first_and_pairs_stay_within_them(spark):
    model = languages.learned(table(spark, made()))
    assert model.languages == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "=xx": ["xx"]}
    expected = {(None, *p) for p in combinations(["=xx", "germanic", "romance"], 2)}
    expected |= {("germanic", *p) for p in combinations(["de", "en", "nl"], 2)} | {("romance", "es", "fr")}
    assert set(model.machines) == set(model.pairs()) == expected
    assert languages.family_of("de-AT") == languages.family_of("DE") == "germanic" and languages.family_of("romance") == "=romance"


def test_votes_decide_then_margins():
    """Against a plain tally of each pair's decision."""
    rng = np.random.default_rng(4)
    model = languages.Model({"g": ["a", "b", "c"], "r": ["d", "e"]})
    model.machines = {p: rng.normal(size=languages._SIZE).astype(np.float32) for p in model.pairs()}
    texts = ["".join(rng.choice(list("abc de"), 12)) + "z" for _ in range(200)]
    features = languages.Features(pa.array(texts))
    every = np.ones(len(texts), bool)
    margins = {p: features.margins(w, every) for p, w in model.machines.items()}

    def winner(level, names, i):
        tally = {n: [0, 0.0] for n in names}
        least = dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            m = margins[level, a, b][i]
            tally[a if m > 0 else b][0] += 1
            for n, own in ((a, m), (b, -m)):
                tally[n][1] += own
                least[n] = min(least[n], 1 / (1 + np.exp(-2 * own)))
        best = max(names, key=lambda n: tally[n])
        return best, least[best]

    langs, scores = model.predict(pa.array(texts), every)
    for i in range(len(texts)):
        family, outer = winner(None, ["g", "r"], i)
        lang, inner = winner(family, model.languages[family], i)
        assert langs[i] == lang and scores[i] == pytest.approx(outer * inner)


def test_held_out_rows_are_told_apart_and_teach_nothing(spark):
    rows = made()
    out = {r.doc_id: r for r in languages.identified(spark, table(spark, rows)).collect()}
    assert {i: r.held_out for i, r in out.items()} == {i: held_out(i) for i, _, _ in rows}
    tested = [(i, lang) for i, _, lang in rows if held_out(i)]
    assert sum(out[i].lang_pred == lang for i, lang in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in out.values())
    lies = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in rows]
    again = {r.doc_id: r for r in languages.identified(spark, table(spark, lies)).collect()}
    assert {i: (r.lang_pred, r.score) for i, r in again.items()} == {i: (r.lang_pred, r.score) for i, r in out.items()}


def test_the_sample_is_of_distinct_texts_and_leaves_rare_languages_whole(spark):
    rows = made(each=50) + [(1000 + i, WORDS["en"], "en") for i in range(600)] + [(None, "der und die", "de")] * 300
    out = {r.doc_id: r for r in languages.identified(spark, table(spark, rows), side_rows=20).collect()}
    tested = [(i, lang) for i, _, lang in rows if i is not None and held_out(i)]
    assert sum(out[i].lang_pred == lang for i, lang in tested) >= 0.95 * len(tested)


def test_nulls_letterless_long_and_repeated_texts_and_empty_tables(spark):
    odd = [(None, "the house", None), (5000, None, "en"), (5001, "", "en"), (5002, "12 !?", "fr"), (5003, "le la et " * 60_000, None), (5004, "the", "en")]
    rows = made(langs=("en", "fr")) + odd + [(6000, "la maison", "fr")] * 40
    clashing = table(spark, rows).selectExpr("*", "1 AS held_out", "2.0D AS score", "'q' AS lang_pred", "3 AS key", "4 AS chance", "true AS lettered")
    out = languages.identified(spark, clashing)
    assert tuple(out.columns) == COLUMNS
    out = out.collect()
    assert len(out) == len(rows)
    found = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(found[i] == ("und", 0.0) for i in (5000, 5001, 5002))
    assert found[None][0] == "en" and found[5003][0] == "fr"
    assert len({tuple(r) for r in out if r.doc_id == 6000}) == 1
    assert languages.identified(spark, table(spark, rows).limit(0)).collect() == []
    unlabelled = table(spark, [(i, t, None) for i, t, _ in rows])
    assert {(r.lang_pred, r.score) for r in languages.identified(spark, unlabelled).collect()} == {("und", 0.0)}
    alone = table(spark, made(langs=("en",)))
    assert {(r.lang_pred, r.score) for r in languages.identified(spark, alone).collect()} == {("en", 1.0)}


def test_the_query_on_the_table(spark):
    out = {r.doc_id: r for r in queries.op13_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    tested = [r for r in docs if held_out(r.doc_id)]
    assert len(out) == len(docs) and len(tested) > 200
    right = sum(out[r.doc_id].lang_pred == r.lang for r in tested) / len(tested)
    assert right >= 0.95, right
