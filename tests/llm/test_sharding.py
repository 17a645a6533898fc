import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindlewatch.llm import sharding


def jump(key, buckets):
    """The published loop."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_buckets_are_those_of_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 256, 10863919174838991] + [k * 0x9E3779B97F4A7C15 % 2**63 for k in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 100):
        got = {r.k: tuple(r.b) for r in df.select("k", sharding.jump(F.col("k"), n).alias("b")).collect()}
        assert got == {k: (jump(k, n), jump(k, n + 1)) for k in keys}
    with pytest.raises(ValueError):
        sharding.jump(F.lit(1), 0)


def test_rows_are_numbered_without_gaps_and_move_only_to_the_new_shard(spark, documents):
    rows = [(i * 37, f"text {i} é" * (i % 5)) for i in range(500)] + [(7, "same")] * 300 + [(None, None), (3, None), (3, "")]
    out = sharding.sharded(spark, documents(rows)).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for shard in range(16):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in out if r.shard == shard)
        assert [s for s, *_ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in out)
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    assert 0 < sum(r.grown_shard == 16 for r in out if r.doc_id != 7) < 100


def test_the_plan_runs_no_python(spark, documents):
    plan = sharding.sharded(spark, documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables_and_clashing_columns(spark, documents):
    assert sharding.sharded(spark, documents([])).collect() == []
    docs = documents([(1, "a"), (2, "b")]).selectExpr("*", "1 AS shard", "2 AS size", "3 AS place", "4 AS row")
    assert sorted(r.doc_id for r in sharding.sharded(spark, docs).collect()) == [1, 2]
    assert sharding.assigned(docs).select("row.*").columns == docs.columns
