"""Raw files that arrive over time, cleaned into one growing telemetry table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spindlewatch.operators.cleaning import clean
from spindlewatch.schema import TELEMETRY
from spindlewatch.shared import written
from spindlewatch.sinks.tables import write_telemetry
from spindlewatch.sources.tables import check_format, read_telemetry
from spindlewatch.streaming.views import View

# Day first: a batch then looks for earlier copies in its own days only. New rows are brought together by day, so that
# a batch adds few files to each; the rebalance splits a day that holds much of the batch.
LAYOUT = {"partition_by": ("event_date", "failure"), "cluster_by": "event_date"}


def raw_stream(spark: SparkSession, directory: str, schema: StructType, fmt: str = "parquet", **options) -> DataFrame:
    """New raw files in ``directory`` as a stream; ``options`` are the file source's, e.g. maxFilesPerTrigger."""
    return spark.readStream.format(check_format(fmt)).schema(schema).options(**options).load(directory)


# Up to this many days are listed in the filter of a batch's lookup; beyond, the whole table is compared.
MOST_DAYS = 10_000


def check_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> None:
    """Raise if the table at ``path`` has files that are not laid out for ingest.

    Files of two layouts in one table cannot be read any more. :func:`convert` makes an ingest table of another.
    """
    try:
        found = spark.read.format(check_format(fmt)).schema(TELEMETRY).load(path).select("_metadata.file_path").take(1)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    folders = re.findall(r"/([^/=]+)=[^/]*(?=/)", found[0].file_path.removeprefix(path)) if found else None
    if folders is not None and tuple(folders[-2:]) != LAYOUT["partition_by"]:
        raise ValueError(f"{path} is partitioned by {folders}, not by {LAYOUT['partition_by']}; convert it first")


def convert(spark: SparkSession, prepared: str, path: str, fmt: str = "parquet") -> None:
    """Write the cleaned table at ``prepared``, of any layout, as a new table at ``path`` that batches can go on."""
    write_telemetry(read_telemetry(spark, prepared, fmt), path, fmt, **LAYOUT, mode="errorifexists")


def new_rows(batch: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """The cleaned rows of ``batch`` that the table at ``path`` does not hold yet.

    Copies can arrive in any file, on any day. Stateful de-duplication would either keep every row ever seen as
    state, or drop late rows at a watermark. The table itself is the memory instead: an anti join on all columns
    against the days that the batch touches. It is exact in any arrival order, holds no state, and makes a batch
    that is run again after a failure write nothing twice.

    Both sides hold a row once and are hashed on every column, so no key of the join can be hot. The batch is cleaned
    once, into a scratch table; its days, no more than the calendar has, filter the partitions of the table exactly.
    """
    cleaned = written(batch.sparkSession, clean(batch), "batch")
    return _absent(cleaned, _days(cleaned), path, fmt)


def _days(cleaned: DataFrame) -> list[date] | None:
    """The days of a batch, or None if there are more than ``MOST_DAYS``."""
    days = [r.event_date for r in cleaned.select("event_date").distinct().take(MOST_DAYS + 1)]
    return days if len(days) <= MOST_DAYS else None


def _absent(cleaned: DataFrame, days: list[date] | None, path: str, fmt: str) -> DataFrame:
    held = read_telemetry(cleaned.sparkSession, path, fmt)
    if days is not None:
        held = held.where(F.col("event_date").isin(days))
    return cleaned.join(held, TELEMETRY.names, "left_anti")


def append_new(batch: DataFrame, path: str, fmt: str = "parquet", views: Sequence[View] = ()) -> None:
    """Append what is new in ``batch`` to the table, then bring each of ``views`` up to date.

    Views take the whole batch, not what was new in it: when a batch runs again, its rows are in the table already.
    """
    spark = batch.sparkSession
    check_layout(spark, path, fmt)
    cleaned = written(spark, clean(batch), "batch")
    days = _days(cleaned)
    write_telemetry(_absent(cleaned, days, path, fmt), path, fmt, **LAYOUT, mode="append")
    for view in views:
        view(cleaned, read_telemetry(spark, path, fmt), days)


def ingest(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    views: Sequence[View] = (),
) -> StreamingQuery:
    """Clean every raw file that has arrived into the table at ``path``, then stop.

    Run it again when more has arrived; ``checkpoint`` remembers which files are done. ``views`` are kept up to date with
    every batch (:mod:`spindlewatch.streaming.views`).
    """
    spark = raw.sparkSession
    check_layout(spark, path, fmt)
    write_telemetry(spark.createDataFrame([], TELEMETRY), path, fmt, **LAYOUT, mode="append")
    return (
        raw.writeStream
        .foreachBatch(lambda batch, _: append_new(batch, path, fmt, views))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
