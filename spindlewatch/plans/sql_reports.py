"""The same reports as SQL text. ``{t}`` is cleaned telemetry, ``{partial}`` the (vault, model) failure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindlewatch.functions.percentiles import ACCURACY

# The names under which cleaned telemetry and its partial are registered for SQL of one's own.
TELEMETRY_VIEW = "DisksMonitor"
PARTIAL_VIEW = "VaultModelFailures"

VAULT_DAYS_SQL = """
SELECT event_date, vault_id, count(*) AS failures_count
FROM {t}
WHERE failure
GROUP BY event_date, vault_id
HAVING array_contains(:counts, count(*))
ORDER BY event_date, vault_id, failures_count
"""

PARTIAL_SQL = """
SELECT vault_id, model, count(*) AS failures_count
FROM {t}
WHERE failure
GROUP BY vault_id, model
"""

TOP_MODELS_SQL = """
SELECT model, sum(failures_count) AS failures_count
FROM {partial}
GROUP BY model
ORDER BY failures_count DESC, model
LIMIT :k
"""

TOP_VAULTS_SQL = """
SELECT vault_id, failures_count, array_join(array_sort(models), ',') AS list_of_models
FROM (
  SELECT vault_id, sum(failures_count) AS failures_count, collect_set(model) AS models
  FROM {partial}
  GROUP BY vault_id
  ORDER BY failures_count DESC, vault_id
  LIMIT :k
)
"""

HOURS_STATS_SQL = """
WITH disks AS (
  SELECT serial_number, bool_or(failure) AS failed, max(s9_power_on_hours) AS hours
  FROM {t}
  GROUP BY serial_number
), summary AS (
  SELECT failed, min(hours) AS low, percentile_approx(hours, array(0.25, 0.5, 0.75), :accuracy) AS q,
         max(hours) AS high, count(*) AS n
  FROM disks
  GROUP BY failed
)
SELECT CAST(failed AS INT) AS failure, low AS min, q[0] AS `25th_percentile`, q[1] AS `50th_percentile`,
       q[2] AS `75th_percentile`, high AS max, n AS count
FROM summary
ORDER BY failure
"""

# The reports as table functions over the two views. A limit must be a constant where a function is made, a place need not
# be; with a constant argument the planner makes a limit of it.
_FUNCTIONS = (
    f"""
CREATE OR REPLACE TEMPORARY FUNCTION vault_days(counts ARRAY<INT> DEFAULT array(2, 3, 4))
RETURNS TABLE(event_date DATE, vault_id INT, failures_count BIGINT)
RETURN SELECT event_date, vault_id, failures_count
FROM (SELECT event_date, vault_id, count(*) AS failures_count FROM {TELEMETRY_VIEW} WHERE failure GROUP BY event_date, vault_id)
WHERE array_contains(counts, CAST(failures_count AS INT))
""",
    f"""
CREATE OR REPLACE TEMPORARY FUNCTION top_models(k INT DEFAULT 10)
RETURNS TABLE(model STRING, failures_count BIGINT)
RETURN SELECT model, failures_count
FROM (
  SELECT model, failures_count, row_number() OVER (ORDER BY failures_count DESC, model) AS place
  FROM (SELECT model, sum(failures_count) AS failures_count FROM {PARTIAL_VIEW} GROUP BY model)
)
WHERE place <= k
""",
    f"""
CREATE OR REPLACE TEMPORARY FUNCTION top_vaults(k INT DEFAULT 10)
RETURNS TABLE(vault_id INT, failures_count BIGINT, list_of_models STRING)
RETURN SELECT vault_id, failures_count, array_join(array_sort(models), ',') AS list_of_models
FROM (
  SELECT vault_id, failures_count, models, row_number() OVER (ORDER BY failures_count DESC, vault_id) AS place
  FROM (SELECT vault_id, sum(failures_count) AS failures_count, collect_set(model) AS models FROM {PARTIAL_VIEW} GROUP BY vault_id)
)
WHERE place <= k
""",
    # Exact quartiles. A sketch puts fences around each quartile's rank, by twice its error; disks below the low fence
    # are only counted, and the values between the fences are counted by value. The sum of the counts up to a value is its
    # rank, so only what lies between two fences is sorted. Where the definition takes the mean of two values, the second is the next one.
    f"""
CREATE OR REPLACE TEMPORARY FUNCTION hours_stats()
RETURNS TABLE(failure INT, min DOUBLE, `25th_percentile` DOUBLE, `50th_percentile` DOUBLE, `75th_percentile` DOUBLE, max DOUBLE, count BIGINT)
RETURN WITH disks AS (
  SELECT serial_number, bool_or(failure) AS failed, max(s9_power_on_hours) AS hours
  FROM {TELEMETRY_VIEW} GROUP BY serial_number
), counted AS (
  SELECT failed, hours, count(*) AS n FROM disks GROUP BY failed, hours
), summary AS (
  SELECT failed, min(hours) AS low, max(hours) AS high, count(*) AS n,
         percentile_approx(hours, array(0.2498, 0.2502, 0.4998, 0.5002, 0.7498, 0.7502), {ACCURACY}) AS fences
  FROM disks GROUP BY failed
), marks AS (
  SELECT failed, n, low, high, quarter, fences[2 * quarter - 2] AS from_hours, fences[2 * quarter - 1] AS to_hours
  FROM summary LATERAL VIEW explode(array(1, 2, 3)) AS quarter
), stretches AS (
  SELECT /*+ BROADCAST(m) */ m.failed, m.quarter, m.n AS disks, c.n,
         CASE WHEN c.hours < m.from_hours THEN NULL WHEN c.hours > m.to_hours THEN m.to_hours ELSE c.hours END AS hours,
         c.hours > m.to_hours AS above, CASE WHEN c.hours > m.to_hours THEN c.hours END AS beyond
  FROM counted AS c JOIN marks AS m ON c.failed = m.failed
), groups AS (
  SELECT failed, quarter, disks, above, hours, sum(n) AS n, coalesce(min(beyond), hours) AS value
  FROM stretches GROUP BY failed, quarter, disks, above, hours
), ranked AS (
  SELECT failed, quarter, disks, value,
         sum(n) OVER (PARTITION BY failed, quarter ORDER BY above, hours NULLS FIRST) AS up_to,
         n
  FROM groups
), quartiles AS (
  SELECT failed, quarter,
         (min(CASE WHEN 4 * up_to >= disks * quarter THEN value END) + min(CASE WHEN 4 * up_to > disks * quarter THEN value END)) / 2 AS value
  FROM ranked GROUP BY failed, quarter
), wide AS (
  SELECT failed, max(CASE WHEN quarter = 1 THEN value END) AS q1, max(CASE WHEN quarter = 2 THEN value END) AS q2,
         max(CASE WHEN quarter = 3 THEN value END) AS q3
  FROM quartiles GROUP BY failed
)
SELECT CAST(s.failed AS INT), s.low, w.q1, w.q2, w.q3, s.high, s.n FROM summary AS s JOIN wide AS w ON s.failed = w.failed
""",
)


def register_functions(spark: SparkSession, df: DataFrame) -> None:
    """The views of :func:`register_views`, and the reports as table functions over them: ``vault_days(counts)``, ``top_models(k)``,
    ``top_vaults(k)`` and ``hours_stats()``, whose quartiles are exact. Order their rows as you like."""
    register_views(spark, df)
    for function in _FUNCTIONS:
        spark.sql(function)


def register_views(spark: SparkSession, df: DataFrame) -> None:
    """Make cleaned telemetry and its (vault, model) failure counts available to ``spark.sql`` by name."""
    df.createOrReplaceTempView(TELEMETRY_VIEW)
    partial_sql(spark, df).createOrReplaceTempView(PARTIAL_VIEW)


def vault_days_sql(spark: SparkSession, df: DataFrame, counts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    return spark.sql(VAULT_DAYS_SQL, args={"counts": [int(c) for c in counts]}, t=df)


def partial_sql(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.sql(PARTIAL_SQL, t=df)


def top_models_sql(spark: SparkSession, df: DataFrame, k: int = 10) -> DataFrame:
    return top_models_sql_from(spark, partial_sql(spark, df), k)


def top_models_sql_from(spark: SparkSession, partial: DataFrame, k: int = 10) -> DataFrame:
    return spark.sql(TOP_MODELS_SQL, args={"k": k}, partial=partial)


def top_vaults_sql(spark: SparkSession, df: DataFrame, k: int = 10) -> DataFrame:
    return top_vaults_sql_from(spark, partial_sql(spark, df), k)


def top_vaults_sql_from(spark: SparkSession, partial: DataFrame, k: int = 10) -> DataFrame:
    return spark.sql(TOP_VAULTS_SQL, args={"k": k}, partial=partial)


def hours_stats_sql(spark: SparkSession, df: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    return spark.sql(HOURS_STATS_SQL, args={"accuracy": accuracy}, t=df)
