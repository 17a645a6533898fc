import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spindlewatch.llm import quality

SF = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def made(seed=1):
    rng = random.Random(seed)
    good = [" ".join(rng.choice(["the", "of", "sea", "hill", "rain,", "and"]) for _ in range(rng.randrange(5, 60))) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY", "now!!", "$$$", "win###"]) for _ in range(rng.randrange(5, 60))) for _ in range(150)]
    return [(2 * i, t, 1) for i, t in enumerate(good)] + [(2 * i + 1, t, 0) for i, t in enumerate(bad)]


@pytest.fixture
def tables(spark, documents):
    def make(rows):
        labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id long, quality int, toxic int")
        return documents([(i, t) for i, t, _ in rows]), labels

    return make


def test_a_text_has_four_grams_for_each_token_whatever_its_batch():
    texts = ["One two, THREE", None, "", "a1b2 --", "x x x\n x", "Ünï çødé 12.5%"]
    grams, counts = quality.features(pa.array(texts))
    assert counts.tolist() == [16, 0, 0, 20, 16, 24]
    alone = [quality.features(pa.array([t], pa.string()))[0] for t in texts]
    assert np.array_equal(grams, np.concatenate(alone))
    assert grams.min() >= 0 and grams.max() < 1 << quality.BITS


def test_scores_are_the_sparse_dot_products():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << quality.BITS) + 1)
    texts = [t for _, t, _ in made()][:20] + [None, ""]
    expected = []
    for t in texts:
        grams, _ = quality.features(pa.array([t], pa.string()))
        margin = weights[-1] + (quality._SCALE * weights[grams].mean() if len(grams) else 0)
        expected.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
    assert np.allclose(quality.scores(pa.array(texts), weights), expected)


def test_held_out_rows_are_told_apart_and_teach_nothing(spark, tables):
    rows = made()
    docs, labels = tables(rows)
    out = {r.doc_id: r for r in quality.classified(spark, docs, labels).collect()}
    assert {i: r.held_out for i, r in out.items()} == {i: held_out(i) for i, _, _ in rows}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())
    tested = [(i, q) for i, _, q in rows if held_out(i)]
    assert sum(out[i].predicted == q for i, q in tested) >= 0.98 * len(tested)

    lies, lied = tables([(i, t, 1 - q if held_out(i) else q) for i, t, q in rows])
    again = {r.doc_id: r.score for r in quality.classified(spark, lies, lied).collect()}
    assert all(abs(out[i].score - s) < 1e-9 for i, s in again.items())


def test_languages_sources_and_ids_are_no_inputs(spark, tables):
    rows = [*made(), (5001, "the sea and rain, of the hill", None), (5002, "the sea and rain, of the hill", None)]
    docs, labels = tables(rows)
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "concat('s', doc_id) AS source", "0L AS n_chars", "1 AS held_out", "2 AS label")
    a = {r.doc_id: r.score for r in quality.classified(spark, docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classified(spark, other, labels).collect()}
    assert abs(a[5001] - a[5002]) < 1e-9 and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_nulls_repeated_rows_and_empty_tables(spark, tables, documents):
    docs, labels = tables([(None, "x", None), (3, None, 1), (3, None, 1), (4, "", 0)])
    out = quality.classified(spark, docs, labels).collect()
    assert len(out) == 4 and len({round(r.score, 9) for r in out if r.doc_id}) == 1
    none = labels.limit(0)
    assert {r.score for r in quality.classified(spark, docs, none).collect()} == {0.5}
    assert quality.classified(spark, documents([]), labels).collect() == []


def test_real_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality.classified(spark, docs, labels).collect()}
    tested = [r for r in labels.collect() if held_out(r.doc_id)]
    assert len(out) == 1000 and len(tested) > 50
    assert sum(out[r.doc_id].predicted == r.quality for r in tested) >= 0.95 * len(tested)


def test_the_sample_is_bounded(spark, tables):
    docs, labels = tables(made())
    few = quality.learned(docs, labels, train_rows=40)
    assert few.shape == ((1 << quality.BITS) + 1,) and np.abs(few).sum() > 0
