"""Telemetry-shaped views over the shared ``events`` table, for checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _hours() -> Column:
    return (
        (F.col("user_id") * 7919) % 80000
        + (F.col("event_id") % 7) * 331
        + (F.day("ts") - 1) * 24
        + F.hour("ts")
    )


def _failed() -> Column:
    return (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)


def _disk(prefix: Column | str) -> Column:
    return F.concat(prefix, F.col("user_id").cast("string"), F.lit("_"), (F.col("event_id") % 7).cast("string"))


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def raw_telemetry(events: DataFrame) -> DataFrame:
    """Dirty daily telemetry, all strings: nulls, bad identifiers, identifiers that end in a newline, unparsable hours,
    vaults written as decimal fractions, and duplicates, half of which differ in a column that no report uses."""
    copies = F.when(_every(10), 2).otherwise(1)
    return events.select(
        F.col("ts").cast("date").cast("string").alias("date"),
        F.concat(_disk(F.when(_every(83), "sn#").otherwise("SN-")), F.when(_every(67), "\n").otherwise("")).alias("serial_number"),
        F.when(_every(97), F.lit(None).cast("string"))
        .when(_every(89), F.concat(F.lit("mdl "), (F.col("user_id") % 25).cast("string")))
        .otherwise(F.concat(F.lit("MDL "), (F.col("user_id") % 25).cast("string")))
        .alias("model"),
        F.when(_failed(), "1").otherwise("0").alias("failure"),
        F.when(
            ~_every(73),
            F.concat((1000 + F.col("user_id") % 40).cast("string"), F.when(_every(71), ".0").otherwise("")),
        ).alias("vault_id"),
        F.when(_every(79), "n/a").otherwise(_hours().cast("string")).alias("s9_power_on_hours"),
        _every(20).alias("differ"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).select(
        "date", "serial_number", "model", "failure", "vault_id", "s9_power_on_hours",
        F.when(F.col("differ"), F.col("copy").cast("string")).otherwise("1").alias("capacity"),
    )


def reset_telemetry(events: DataFrame) -> DataFrame:
    """Clean telemetry in which the hour counter of every fifth user's disks restarts late in the month."""
    restarted = (F.col("user_id") % 5 == 0) & (F.day("ts") > 20)
    return events.select(
        F.col("ts").cast("date").alias("event_date"),
        _disk(F.lit("SN-")).alias("serial_number"),
        F.concat(F.lit("MDL "), (F.col("user_id") % 25).cast("string")).alias("model"),
        _failed().alias("failure"),
        (1000 + F.col("user_id") % 40).cast("int").alias("vault_id"),
        (_hours().cast("double") * F.when(restarted, 0.5).otherwise(1.0)).alias("s9_power_on_hours"),
    )


def timing_log(events: DataFrame) -> DataFrame:
    """A run-time log in the benchmark's shape, one run per event; times are whole eighths of a second."""
    return events.select(
        F.concat(F.lit("query"), (F.col("user_id") % 3 + 1).cast("string")).alias("query"),
        F.when(F.col("event_id") % 2 == 0, "parquet").otherwise("avro").alias("format"),
        (F.col("user_id") % 4 + 1).cast("int").alias("worker_nodes"),
        (F.floor(F.col("value") * 8) / 8).cast("double").alias("execution_time"),
    )
