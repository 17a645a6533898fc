"""Times the cleaning job and the reports; prints one JSON line.

``queries`` runs on the telemetry view of the events table in ``$BENCH_SF_DIR``. ``three_million_rows`` runs the same
on that view enlarged, by Spark, to about three million rows: every event is repeated for further users.
The reports read the cleaned parquet table; their times span scan to last result row, with the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import tempfile
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.operators.cleaning import clean
from spindlewatch.operators.failures import failures_by_day_vault_model
from spindlewatch.plans import reports, sql_reports
from spindlewatch.plans.job import materialize
from spindlewatch.plans.timing import run_seconds, timed
from spindlewatch.shared import scratch_path
from spindlewatch.sinks.tables import BY_DISK, write_bucketed, write_telemetry
from spindlewatch.sources.events_view import raw_telemetry, read_events
from spindlewatch.sources.tables import read_bucketed, read_raw, read_telemetry

RUNS = int(os.environ.get("BENCH_RUNS", "5"))
TARGET_ROWS = int(os.environ.get("BENCH_TARGET_ROWS", "3000000"))


def enlarge(events: DataFrame, copies: int) -> DataFrame:
    """Repeat every event for ``copies`` sets of users."""
    users = events.agg(F.max("user_id")).first()[0] + 1
    return (
        events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("user_id", F.col("user_id") + F.col("copy") * users)
        .drop("copy")
    )


def median_of(case: Callable[[], float]) -> float:
    """Median seconds of the measured runs, after one that warms up."""
    case()
    return round(statistics.median(case() for _ in range(RUNS)), 3)


def failure_reports(table: DataFrame) -> float:
    """All three failure reports from one scan, as the batch job runs them."""
    def all_three() -> None:
        counts = materialize(failures_by_day_vault_model(table), scratch_path(table.sparkSession, "partial"))
        for report in (reports.vault_days_from, reports.top_models_from, reports.top_vaults_from):
            run_seconds(report(counts))

    return timed(all_three)


def bench(spark: SparkSession, events: DataFrame) -> tuple[dict[str, float], int]:
    """Seconds by query, over a plain table, the batch job's default, over one by disk and over a bucketed one."""
    raw_path = scratch_path(spark, "raw")
    # One file per core: a single small file would be read by one task.
    raw_telemetry(events).repartition(spark.sparkContext.defaultParallelism).write.parquet(raw_path)
    seconds, rows = {}, 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layouts = {
        "": (write_telemetry, lambda path: read_telemetry(spark, path)),
        "_by_disk": (partial(write_telemetry, cluster_by=BY_DISK), lambda path: read_telemetry(spark, path)),
        "_bucketed": (partial(write_bucketed, buckets=buckets), lambda path: read_bucketed(spark, path, buckets)),
    }
    for suffix, (write, read) in layouts.items():
        clean_path = scratch_path(spark, "clean")
        seconds["clean" + suffix] = median_of(lambda: timed(lambda: write(clean(read_raw(spark, raw_path)), clean_path)))
        table = read(clean_path)
        cases = {
            "query1": lambda: run_seconds(reports.vault_days(table)),
            "query2_models": lambda: run_seconds(reports.top_models(table)),
            "query2_vaults": lambda: run_seconds(reports.top_vaults(table)),
            "query3": lambda: run_seconds(reports.hours_stats(table)),
            "query3_approx": lambda: run_seconds(reports.hours_stats_approx(table)),
            "query3_latest": lambda: run_seconds(reports.hours_stats(table, "latest")),
            "sql_query1": lambda: run_seconds(sql_reports.vault_days_sql(spark, table)),
            "sql_query2_models": lambda: run_seconds(sql_reports.top_models_sql(spark, table)),
            "sql_query2_vaults": lambda: run_seconds(sql_reports.top_vaults_sql(spark, table)),
            "sql_query3": lambda: run_seconds(sql_reports.hours_stats_sql(spark, table)),
            "failure_reports_shared": lambda: failure_reports(table),
        }
        seconds |= {name + suffix: median_of(case) for name, case in cases.items()}
        rows = table.count()
    return seconds, rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # tasks share one machine
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = read_events(spark, sf_dir)
    seconds, rows = bench(spark, events)
    copies = max(1, round(TARGET_ROWS / rows))
    large_seconds, large_rows = bench(spark, enlarge(events, copies))
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "median seconds over all queries, summed",
        # Of the plain table, as in earlier rounds.
        "value": round(sum(t for name, t in seconds.items() if not name.endswith(("_by_disk", "_bucketed"))), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
        "rows": rows,
        "three_million_rows": {"rows": large_rows, "queries": large_seconds},
        "runs": RUNS,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
