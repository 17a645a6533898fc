"""One row per disk: whether it ever failed, and its power-on hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disk_collapse(df: DataFrame, hours: str = "max") -> DataFrame:
    """Collapse telemetry to one row per serial number.

    ``hours="max"`` takes the largest reading. ``hours="latest"`` takes the reading of the last day (the largest of
    that day), which differs where a counter was reset.

    Both are partial aggregates: each task sends one row per disk, so a disk holding a third of the rows adds no
    more to the shuffle than any other. ``max`` keeps fixed-width state and runs as a hash aggregate; ``latest``
    orders by a (day, hours) struct, which Spark runs as a sort aggregate.
    """
    if hours == "max":
        reading = F.max("s9_power_on_hours")
    elif hours == "latest":
        reading = F.max_by("s9_power_on_hours", F.struct("event_date", "s9_power_on_hours"))
    else:
        raise ValueError(f"hours must be 'max' or 'latest', not {hours!r}")
    return df.groupBy("serial_number").agg(
        F.bool_or("failure").alias("failure"),
        reading.alias("s9_power_on_hours"),
    )


def hours_min_max_count(disks: DataFrame) -> DataFrame:
    """Smallest and largest hours and the number of disks, for failed and never-failed disks."""
    return disks.groupBy(F.col("failure").cast("int").alias("failure")).agg(
        F.min("s9_power_on_hours").alias("min"),
        F.max("s9_power_on_hours").alias("max"),
        F.count("*").alias("count"),
    )
