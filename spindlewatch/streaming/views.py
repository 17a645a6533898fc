"""Small tables that an ingest keeps up to date batch by batch, so that reports need not read the whole history.

A view is called with each batch after its rows are in the telemetry table. A batch that runs again after a failure leaves
every view as if it had run once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.operators.failures import failures_by_day_vault_model
from spindlewatch.plans.reports import vault_days
from spindlewatch.schema import HOURS_STATS, QUARTILES, VAULT_DAYS

# The state of this many groups of disks is read and written as a whole. Each should fit a task: 256 do for some billion disks.
BUCKETS = 256
# The size parameter of the KLL sketches; the rank error, 1.7 % at 200, shrinks nearly in proportion.
SKETCH_ITEMS = 800


class View(Protocol):
    def __call__(self, batch: DataFrame, table: DataFrame, days: Sequence[date] | None) -> None:
        """Take in ``batch``, cleaned rows that are in ``table`` by now. ``days`` are its days, or None if they are many."""


def _of_days(table: DataFrame, days: Sequence[date] | None) -> DataFrame:
    return table if days is None else table.where(F.col("event_date").isin(list(days)))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What has been written at ``path``, which may be nothing."""
    found = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    return found.select(*schema.names)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _replace(df: DataFrame, path: str, partition: str) -> None:
    """Write ``df`` in the place of the partitions that it has rows of; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _merge(disks: DataFrame, *keys: str) -> DataFrame:
    """Rows of the disk state to one for each of ``keys``."""
    found = disks.groupBy(*keys).agg(
        F.bool_or("failure").alias("failure"),
        F.max("most_hours").alias("most_hours"),
        F.max(F.struct("last_day", "last_hours")).alias("last"),
    )
    return found.select(*keys, "failure", "most_hours", "last.last_day", "last.last_hours")


@dataclass(frozen=True)
class DiskState:
    """One row a disk: whether it ever failed, its largest hours, and its last day with that day's largest hours.

    All are maxima, so batches may come in any order and any number of times. A batch is collapsed to disks and merged
    with the state of the buckets that its disks hash to; no other bucket is read or written.

    Each bucket has two slots, and a small table, ``heads``, says which one holds. A batch writes the other slots of its
    buckets and then, with one file, new heads; until then readers see the state before it, whatever becomes of the
    batch. A slot is written again two batches later, so a reader has that long. One batch may run at a time, and a state
    keeps the number of buckets that it began with.
    """

    path: str
    buckets: int = BUCKETS

    SCHEMA = T.StructType([
        T.StructField("serial_number", T.StringType()),
        T.StructField("failure", T.BooleanType()),
        T.StructField("most_hours", T.DoubleType()),
        T.StructField("last_day", T.DateType()),
        T.StructField("last_hours", T.DoubleType()),
        T.StructField("slot", T.IntegerType()),
    ])
    HEADS = T.StructType([
        T.StructField("version", T.LongType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("turn", T.IntegerType()),
    ])
    SKETCHES = T.StructType([
        T.StructField("failure", T.BooleanType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("slot", T.IntegerType()),
    ])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("serial_number"), F.lit(self.buckets)).cast("int")

    def heads(self, spark: SparkSession) -> tuple[int, list[int]]:
        """Version and slots of the state that holds, at most one slot a bucket."""
        rows = _read(spark, f"{self.path}/heads", self.HEADS).collect()
        version = max((r.version for r in rows), default=0)
        return version, sorted(r.slot for r in rows if r.version == version)

    def state(self, spark: SparkSession, slots: Sequence[int]) -> DataFrame:
        return _read(spark, f"{self.path}/disks", self.SCHEMA).where(F.col("slot").isin(list(slots)))

    def _slot(self, odd: Sequence[int]) -> Column:
        """Each disk's slot, the second one for the ``odd`` buckets."""
        second = F.array_contains(F.array(*[F.lit(b) for b in odd]).cast("array<int>"), self._bucket())
        return 2 * self._bucket() + second.cast("int")

    def merged(self, batch: DataFrame, slots: Sequence[int], odd: Sequence[int] = ()) -> DataFrame:
        """The disks of ``batch`` and of the state in ``slots`` together, with their new slots.

        The batch is collapsed before it meets the state, whose rows move once, to the task of their bucket.
        """
        now = _merge(batch.select(
            "serial_number", "failure", F.col("s9_power_on_hours").alias("most_hours"), F.col("event_date").alias("last_day"),
            F.col("s9_power_on_hours").alias("last_hours"),
        ), "serial_number")
        both = now.unionByName(self.state(batch.sparkSession, slots).drop("slot")).withColumn("slot", self._slot(odd))
        return _merge(both.repartition("slot"), "serial_number", "slot").select(*self.SCHEMA.names)

    def __call__(self, batch: DataFrame, table: DataFrame, days: Sequence[date] | None) -> None:
        spark = batch.sparkSession
        version, held = self.heads(spark)
        touched = {r.bucket for r in batch.select(self._bucket().alias("bucket")).distinct().collect()}
        if not touched:
            return
        slot_of = {slot // 2: slot for slot in held}
        old = [slot for bucket, slot in slot_of.items() if bucket in touched]
        new = {bucket: 2 * bucket + 1 - slot_of.get(bucket, 2 * bucket + 1) % 2 for bucket in touched}
        odd = [bucket for bucket, slot in new.items() if slot % 2]
        _replace(self.merged(batch, old, odd), f"{self.path}/disks", "slot")
        fresh = self.state(spark, list(new.values()))
        _replace(self._sketched(fresh).hint("rebalance", "slot"), f"{self.path}/sketches", "slot")
        slots = sorted((slot_of | new).values())
        heads = spark.createDataFrame([(version + 1, slot, (version + 1) % 2) for slot in slots], self.HEADS).coalesce(1)
        _replace(heads, f"{self.path}/heads", "turn")

    def disks(self, spark: SparkSession, hours: str = "max") -> DataFrame:
        """What :func:`spindlewatch.operators.disks.disk_collapse` makes of the whole table."""
        if hours not in ("max", "latest"):
            raise ValueError(f"hours must be 'max' or 'latest', not {hours!r}")
        reading = "most_hours" if hours == "max" else "last_hours"
        held = self.state(spark, self.heads(spark)[1])
        return held.select("serial_number", "failure", F.col(reading).alias("s9_power_on_hours"))

    @staticmethod
    def _sketched(disks: DataFrame) -> DataFrame:
        return disks.groupBy("failure", "slot").agg(
            F.min("most_hours").alias("min"),
            F.max("most_hours").alias("max"),
            F.count("*").alias("count"),
            F.kll_sketch_agg_double("most_hours", SKETCH_ITEMS).alias("sketch"),
        ).select(*DiskState.SKETCHES.names)

    def hours_stats(self, spark: SparkSession) -> DataFrame:
        """Number of disks, least and greatest hours and quartiles by the merged sketches, as the approximate report: two
        rows a bucket are read, however many disks there are."""
        held = _read(spark, f"{self.path}/sketches", self.SKETCHES).where(F.col("slot").isin(self.heads(spark)[1]))
        marks = [F.kll_sketch_get_quantile_double("one", F.lit(p)).alias(name) for name, p in QUARTILES.items()]
        merged = held.groupBy(F.col("failure").cast("int").alias("failure")).agg(
            F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"), F.kll_merge_agg_double("sketch").alias("one"),
        )
        stats = merged.select("failure", "min", *marks, "max", "count")
        return HOURS_STATS.sorted(stats.select(*HOURS_STATS.schema.names))


@dataclass(frozen=True)
class FailureCounts:
    """Failures by day, vault and model, the partial of all failure reports.

    The days of a batch are counted anew from their failed rows in the telemetry table and replace what the view had of
    them. Counts are no maxima: adding a batch's own would count late copies twice.
    """

    path: str

    SCHEMA = T.StructType([
        T.StructField("event_date", T.DateType()),
        T.StructField("vault_id", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("failures_count", T.LongType()),
    ])

    @staticmethod
    def counted(table: DataFrame, days: Sequence[date] | None) -> DataFrame:
        return failures_by_day_vault_model(_of_days(table, days))

    def __call__(self, batch: DataFrame, table: DataFrame, days: Sequence[date] | None) -> None:
        _replace(self.counted(table, days).hint("rebalance", "event_date"), self.path, "event_date")

    def read(self, spark: SparkSession) -> DataFrame:
        return _read(spark, self.path, self.SCHEMA)


@dataclass(frozen=True)
class VaultDayChanges:
    """The vault-days with one of ``counts`` failures as a log of changes: a row of weight 1 says that one is in the report
    from now on, one of weight -1 that it is no longer, as its count has grown.

    A batch compares its days in the table with what the log adds up to for them and appends the difference. So the log
    is right whatever the order of the files, and a batch that broke off in the middle adds what is missing when it runs
    again. A vault-day enters and leaves once for each count at most, which bounds the log by days times vaults.
    """

    path: str
    counts: tuple[int, ...] = (2, 3, 4)

    SCHEMA = T.StructType([*VAULT_DAYS.schema.fields, T.StructField("weight", T.IntegerType())])

    def changes(self, spark: SparkSession) -> DataFrame:
        return _read(spark, self.path, self.SCHEMA)

    def _summed(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy(*VAULT_DAYS.schema.names).agg(F.sum("weight").alias("weight")).where("weight > 0").drop("weight")

    def difference(self, table: DataFrame, days: Sequence[date] | None) -> DataFrame:
        """What has to be added to the log so that it adds up to the report over ``days``."""
        names = VAULT_DAYS.schema.names
        now = vault_days(_of_days(table, days), self.counts).withColumn("weight", F.lit(1))
        said = self._summed(_of_days(self.changes(table.sparkSession), days)).withColumn("weight", F.lit(-1))
        both = now.unionByName(said).groupBy(*names).agg(F.sum("weight").cast("int").alias("weight"))
        return both.where("weight != 0")

    def __call__(self, batch: DataFrame, table: DataFrame, days: Sequence[date] | None) -> None:
        self.difference(table, days).write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """The report as of now."""
        return VAULT_DAYS.sorted(self._summed(self.changes(spark)))
