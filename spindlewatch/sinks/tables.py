"""Writers for telemetry tables and report results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewatch.schema import Report
from spindlewatch.sources.tables import bucketed_name, check_format

# Rows of healthy days by disk. Failed rows, few and read apart from the others, have 64 keys of their own.
BY_DISK = "CASE WHEN failure THEN pmod(xxhash64(serial_number), 64) ELSE xxhash64(serial_number) END"


def write_telemetry(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = ("failure",),
    cluster_by: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Write cleaned telemetry, split by ``partition_by``.

    Failures are rare and two of the three reports read nothing else, so the default layout lets those scan the
    ``failure=true`` files alone. Every task writes its own files; ``()`` gives an unpartitioned table.

    ``cluster_by``, a SQL expression, brings rows with equal keys together, at the price of one more shuffle here.
    With ``BY_DISK`` every later collapse to disks combines nearly all rows before its own shuffle, and the failed
    rows fill a few files of their own instead of a small one per task. It pays from some ten million rows that are reported
    on more than once. It is a rebalance, so a key with very many rows is split over several tasks, and small ones are merged.
    """
    if cluster_by:
        df = df.withColumn("__key", F.expr(cluster_by)).hint("rebalance", "__key").drop("__key")
    # An overwrite replaces the whole table, whatever the session has set.
    writer = df.write.format(check_format(fmt)).mode(mode).option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, partition_by: Sequence[str] = ("failure",)) -> None:
    """Write cleaned telemetry as a parquet table whose files hold ``buckets`` hash groups of disks, one file a group.

    The planner knows this layout, so a collapse to disks over :func:`spindlewatch.sources.tables.read_bucketed` does not
    shuffle at all. The price is one shuffle here, and that a bucket is one task wherever the planner uses it: choose as many
    buckets as shuffle partitions, and the plain layout for a table in which single disks hold a large share of the rows.
    The files are ordinary parquet, which :func:`spindlewatch.sources.tables.read_telemetry` reads as well.
    """
    name = bucketed_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    # The groups of this repartition are those of the buckets, so each task writes one file a partition.
    (
        df.repartition(buckets, "serial_number")
        .write.format("parquet").mode("overwrite").option("path", path).option("partitionOverwriteMode", "static")
        .partitionBy(*partition_by).bucketBy(buckets, "serial_number").sortBy("serial_number").saveAsTable(name)
    )


def write_result(df: DataFrame, directory: str, report: Report) -> str:
    """Write a report as CSV with a header, in the report's order; ``file://`` directories work as well.

    The order holds within and across the part files, whose names sort as their rows do. Adaptive execution merges
    a small result into one part; a large one stays spread out, since nothing forces it through a single task.
    """
    path = f"{directory}/{report.name}.csv"
    report.sorted(df).write.csv(path, header=True, mode="overwrite")
    return path
