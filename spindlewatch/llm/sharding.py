"""Shards by jump consistent hashing (Lamping and Veach, 2014), as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindlewatch.shared import written

# Fixed value: the multiplier of the generator that jump hashing draws its jumps from.
_MULTIPLIER = 2862933555777941757
_LIMB = (1 << 24) - 1


def _next_state(state: Column) -> Column:
    """``state * _MULTIPLIER + 1`` modulo 2^64, in limbs of 24 bits, as a product that overflows is an error."""
    k = [state.bitwiseAND(_LIMB), F.shiftrightunsigned(state, 24).bitwiseAND(_LIMB), F.shiftrightunsigned(state, 48)]
    c = [F.lit(_MULTIPLIER >> by & _LIMB).cast("long") for by in (0, 24, 48)]
    low = k[0] * c[0] + 1
    middle = k[0] * c[1] + k[1] * c[0] + F.shiftright(low, 24)
    high = k[0] * c[2] + k[1] * c[1] + k[2] * c[0] + F.shiftright(middle, 24)
    return (
        low.bitwiseAND(_LIMB)
        .bitwiseOR(F.shiftleft(middle.bitwiseAND(_LIMB), 24))
        .bitwiseOR(F.shiftleft(high.bitwiseAND((1 << 16) - 1), 48))
    )


def jump(key: Column, shards: int) -> Column:
    """Struct of the bucket of a 64-bit key among ``shards`` buckets, and of its bucket once there is one more.

    The chain of jumps is the same for any number of buckets, so the two differ only where the key moves to the new one.
    """
    if shards < 1:
        raise ValueError("at least one shard")

    def step(now: Column, _: Column) -> Column:
        state = _next_state(now["state"])
        drawn = F.shiftrightunsigned(state, 33) + 1
        to = F.floor((now["to"] + 1).cast("double") * (F.lit(float(1 << 31)) / drawn.cast("double")))
        moved = F.struct(
            state.alias("state"),
            F.when(now["to"] < shards, now["to"]).otherwise(now["shard"]).alias("shard"),
            now["to"].alias("grown"),
            to.cast("long").alias("to"),
        )
        return F.when(now["to"] <= shards, moved).otherwise(now)

    zero = F.lit(0).cast("long")
    start = F.struct(key.cast("long").alias("state"), zero.alias("shard"), zero.alias("grown"), zero.alias("to"))
    # Each jump goes on by at least one bucket.
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)
    return F.struct(chain["shard"].cast("int").alias("shard"), chain["grown"].cast("int").alias("grown_shard"))


def assigned(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """``docs`` in one struct column ``row``, with ``shard`` and ``grown_shard``. The key, through a hash, and the number
    of shards alone decide; null is a key like any other."""
    own = docs.select(F.struct("*").alias("row"), jump(F.xxhash64(F.col(key)), shards).alias("to"))
    return own.select("row", "to.shard", "to.grown_shard")


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The law is ``key``: doc_id and the number of shards decide, and one more shard takes rows only into itself. size is
    the text's UTF-8 bytes plus one, text_crc32 its unsigned checksum; a null text counts as empty. slot numbers the rows
    of a shard from 0 in order of doc_id, nulls first, then size and checksum; the order of rows equal in all is any.

    Rows are numbered without gathering a shard: they are sorted by range, tasks number their own, and one small
    table of counts, a row for each shard and task, gives the numbers before. Rows with equal keys are cut by their
    place in the input, so a doc_id that many rows share fills no single task.
    """
    rows = assigned(docs.select("doc_id", "text"), shards).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("row.text"), F.lit(""))).cast("long").alias("text_crc32"),
        "shard",
        "grown_shard",
        F.monotonically_increasing_id().alias("place"),
    )
    order = ("shard", "doc_id", "size", "text_crc32")
    ranged = rows.repartitionByRange(*order, "place").sortWithinPartitions(*order).drop("place")
    ranged = written(spark, ranged.withColumn("at", F.monotonically_increasing_id()), "shards")
    ranged = ranged.withColumn("task", F.shiftright("at", 33))
    counts = ranged.groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    # At most as many rows as there are tasks and shards.
    numbered = ranged.join(F.broadcast(bases), ["shard", "task"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("base")).alias("slot"), "grown_shard"
    )
