"""Timed runs of the reports, and their averages."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.sinks.timing_log import timing_frame


def timed(action: Callable[[], object]) -> float:
    """Seconds that ``action`` takes."""
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def session_workers(spark: SparkSession) -> int:
    """Executors that are registered now, so also under dynamic allocation; a local session is one worker.

    A session that does not show them, as a remote one, is asked for what it was configured with.
    """
    if (context := getattr(spark, "sparkContext", None)) is not None:
        # One of them is the driver.
        return max(1, len(context._jsc.sc().statusTracker().getExecutorInfos()) - 1)
    master = spark.conf.get("spark.master", None) or ""
    if found := re.fullmatch(r"local-cluster\[(\d+),.*\]", master):
        return int(found[1])
    return 1 if master.startswith("local") else int(spark.conf.get("spark.executor.instances", "1"))


def run_seconds(frame: DataFrame) -> float:
    """Seconds to compute every row of ``frame``; the ``noop`` sink discards them on the executors."""
    return timed(frame.write.format("noop").mode("overwrite").save)


def measure(
    spark: SparkSession,
    frames: Mapping[str, Callable[[], DataFrame]],
    fmt: str = "parquet",
    worker_nodes: int | None = None,
    runs: int = 10,
    warm_up: int = 1,
) -> DataFrame:
    """Time each frame ``runs`` times, scan to result, as rows of the run-time log."""
    worker_nodes = worker_nodes or session_workers(spark)
    rows = []
    for name, build in frames.items():
        for _ in range(warm_up):
            run_seconds(build())
        rows += [(name, fmt, worker_nodes, run_seconds(build())) for _ in range(runs)]
    return timing_frame(spark, rows)


def mean_times(log: DataFrame) -> DataFrame:
    """Mean run time per query, format and number of workers."""
    return log.groupBy("query", "format", "worker_nodes").agg(F.avg("execution_time").alias("execution_time"))


def total_times(log: DataFrame) -> DataFrame:
    """Total run time of a query over its actions."""
    return log.groupBy("query").agg(F.sum("execution_time").alias("execution_time"))
