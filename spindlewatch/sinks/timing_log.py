"""The run-time log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from spindlewatch.schema import TIMING_LOG


def timing_frame(spark: SparkSession, rows: Iterable[tuple[str, str, int, float]]) -> DataFrame:
    return spark.createDataFrame(list(rows), TIMING_LOG)


def append_timings(log: DataFrame, path: str) -> None:
    """Add runs to the CSV log at ``path``."""
    log.select(*TIMING_LOG.names).write.csv(path, header=True, mode="append")
