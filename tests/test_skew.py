"""One disk, vault, model, day or group of copies holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from spindlewatch.operators.cleaning import clean, dedup_rows
from spindlewatch.operators.disks import disk_collapse
from spindlewatch.plans import reports

N = 300_000
HOT = "id % 3 = 0"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belongs to one failed disk in one vault, each row with its own day and hours."""
    return spark.range(N).repartition(8).selectExpr(
        "date_add(date'2020-01-01', CAST(id % 1000 AS INT)) AS event_date",
        f"CASE WHEN {HOT} THEN 'HOT' ELSE concat('SN-', id % 50000) END AS serial_number",
        f"CASE WHEN {HOT} THEN 'HOT' ELSE concat('M ', id % 40) END AS model",
        f"{HOT} AS failure",
        f"CASE WHEN {HOT} THEN 7 ELSE CAST(100 + id % 500 AS INT) END AS vault_id",
        "CAST(id AS DOUBLE) AS s9_power_on_hours",
    )


def rows_per_task_after(df, *keys):
    return df.repartition(8, *keys).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_distinct_rows_of_a_hot_disk_spread_over_all_tasks(skewed):
    assert dedup_rows(skewed).count() == N
    assert rows_per_task_after(skewed, *skewed.columns) < N / 8 * 1.1


def test_a_hot_group_of_copies_is_combined_before_the_shuffle(spark):
    raw = spark.range(N).repartition(8).selectExpr(
        "'2024-01-01' AS date",
        f"CASE WHEN {HOT} THEN 'SAME' ELSE concat('SN-', id) END AS serial_number",
        "'M' AS model", "'1' AS failure", "'7' AS vault_id", "'5' AS s9_power_on_hours",
    )
    assert clean(raw).count() == N - N // 3 + 1


def test_a_hot_disk_sends_one_row_per_task(skewed):
    disks = disk_collapse(skewed)
    assert disks.where("serial_number = 'HOT'").collect() == [("HOT", True, float(N - 3))]
    plan = disks._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange")[1]
    assert "partial_max" in before


def test_reports_over_skewed_rows(skewed):
    assert reports.top_models(skewed).collect() == [("HOT", N // 3)]
    assert reports.top_vaults(skewed).collect() == [(7, N // 3, "HOT")]
    rows = reports.hours_stats(skewed).collect()
    assert [(r.failure, r["count"]) for r in rows] == [(0, 50_000), (1, 1)]
    never = sorted(
        r[0] for r in disk_collapse(skewed).where("NOT failure").select("s9_power_on_hours").collect()
    )
    assert rows[0]["50th_percentile"] == (never[24_999] + never[25_000]) / 2
