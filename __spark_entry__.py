"""

All entries start from telemetry-shaped views over the whole ``events`` table: ``raw`` (dirty, all strings),
``cleaned`` (what the cleaning job makes of it), ``reset`` (clean, with counters that restart) and a run-time log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.functions import percentiles
from spindlewatch.operators import cleaning, disks, failures
from spindlewatch.plans import job, reports, sql_reports, timing
from spindlewatch.schema import QUARTILES, RAW_COLUMNS, TOP_MODELS, TOP_VAULTS, VAULT_DAYS
from spindlewatch.shared import scratch_path
from spindlewatch.sinks.committed import FolderStore, export_committed
from spindlewatch.sinks.key_value import to_key_value
from spindlewatch.sinks.tables import write_bucketed, write_result, write_telemetry
from spindlewatch.sinks.timing_log import append_timings
from spindlewatch.sources.events_view import raw_telemetry, read_events, reset_telemetry, timing_log
from spindlewatch.sources.mixed import read_raw_groups
from spindlewatch.sources.tables import read_bucketed, read_raw, read_result, read_telemetry, read_timing_log
from spindlewatch.streaming.ingest import ingest, raw_stream
from spindlewatch.streaming.ordered import ingest_ordered
from spindlewatch.streaming.views import DiskState, FailureCounts, VaultDayChanges, View

try:
    from spindlewatch.llm import queries as corpus
except ImportError as absent:
    if absent.name not in ("spindlewatch.llm", "corpus_pipeline"):
        raise
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]

# Fine enough for the approximate quartiles to be the exact discrete ones, which the oracle computes.
FINE_ACCURACY = 1_000_000
# What merged sketches of views.SKETCH_ITEMS items promise.
SKETCH_ERROR = 0.005
# Probabilities whose products with a count are not exact in binary.
OTHER_PERCENTILES = {"p07": 0.07, "p29": 0.29, "p55": 0.55}


def entry(spark: SparkSession) -> DataFrame:
    """The ten models with the most failures, from raw telemetry."""
    return queries()["top_models"](spark, "/root/testdata/sf0.001")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_telemetry(read_events(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(_raw(spark, sf_dir))


def _on_raw(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(_raw(spark, sf_dir))


def _on_cleaned(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(_cleaned(spark, sf_dir))


def _on_reset(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(reset_telemetry(read_events(spark, sf_dir)))


def _on_log(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(timing_log(read_events(spark, sf_dir)))


def _sql(report: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(spark, _cleaned(spark, sf_dir))


def _raw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    _raw(spark, sf_dir).write.parquet(path)
    return read_raw(spark, path, "parquet")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw telemetry in three sets of files, of which one has its hours as numbers and one its days as dates."""
    path, raw = scratch_path(spark, "mixed"), _raw(spark, sf_dir)
    part = F.pmod(F.xxhash64("serial_number"), F.lit(3))
    raw.where(part == 0).write.parquet(path)
    raw.where(part == 1).withColumn("s9_power_on_hours", F.col("s9_power_on_hours").try_cast("double")).write.mode("append").parquet(path)
    raw.where(part == 2).withColumn("date", F.col("date").try_cast("date")).write.mode("append").parquet(path)
    return cleaning.clean_groups(read_raw_groups(spark, path))


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = FolderStore(scratch_path(spark, "store"))
    pairs = to_key_value(reports.vault_days(_cleaned(spark, sf_dir)), VAULT_DAYS)
    for _ in range(2):
        export_committed(pairs, store, "query1")
    return store.read(spark)


def _telemetry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "telemetry")
    write_telemetry(_cleaned(spark, sf_dir), path)
    return read_telemetry(spark, path)


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, buckets = scratch_path(spark, "bucketed"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(_cleaned(spark, sf_dir), path, buckets)
    return read_bucketed(spark, path, buckets)


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch_path(spark, "results")
    write_result(reports.top_vaults(_cleaned(spark, sf_dir)), directory, TOP_VAULTS)
    return read_result(spark, directory, TOP_VAULTS)


def _timing_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "timings")
    log = timing_log(read_events(spark, sf_dir))
    for fmt in ("parquet", "avro"):
        append_timings(log.where(log.format == fmt), path)
    return read_timing_log(spark, path)


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    arriving = (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    path = scratch_path(spark, "ingested")
    ingest(raw_telemetry(arriving), path, scratch_path(spark, "ingest-state")).awaitTermination()
    return read_telemetry(spark, path)


def _kept(spark: SparkSession, sf_dir: str, view: View) -> None:
    """Ingest all telemetry with ``view``: four sets of days in disorder, one file of each a batch, the first set twice."""
    directory, raw = scratch_path(spark, "arriving"), _raw(spark, sf_dir)
    part = F.pmod(F.xxhash64("date"), F.lit(4))
    for number, arrived in enumerate((2, 0, 3, 1, 2)):
        raw.where(part == arrived).coalesce(1).write.parquet(f"{directory}/{number}")
    stream = raw_stream(spark, f"{directory}/*", raw.schema, maxFilesPerTrigger=1)
    ingest(stream, scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state"), views=[view]).awaitTermination()


def _disk_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = DiskState(scratch_path(spark, "disk-state"), buckets=16)
    _kept(spark, sf_dir, view)
    latest = view.disks(spark, "latest").select("serial_number", F.col("s9_power_on_hours").alias("latest_hours"))
    return view.disks(spark).join(latest, "serial_number")


def _disk_state_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = DiskState(scratch_path(spark, "disk-state"), buckets=16)
    _kept(spark, sf_dir, view)
    return _near_ranks(view.disks(spark), view.hours_stats(spark).withColumn("failure", F.col("failure") == 1), SKETCH_ERROR)


def _failure_counts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = FailureCounts(scratch_path(spark, "failure-counts"))
    _kept(spark, sf_dir, view)
    return view.read(spark)


def _stream_vault_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = VaultDayChanges(scratch_path(spark, "vault-day-changes"))
    _kept(spark, sf_dir, view)
    return view.read(spark)


def _stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All telemetry in order of its days, one file for each quarter of them, the first one twice."""
    directory, raw = scratch_path(spark, "arriving"), _raw(spark, sf_dir)
    days = [r.date for r in raw.select("date").distinct().orderBy("date").collect()]
    quarters = [days[i * len(days) // 4 : (i + 1) * len(days) // 4] for i in range(4)]
    for number, arrived in enumerate([quarters[0], *quarters]):
        raw.where(F.col("date").isin(arrived)).coalesce(1).write.parquet(f"{directory}/{number}")
    stream = raw_stream(spark, f"{directory}/*", raw.schema, maxFilesPerTrigger=1)
    path = scratch_path(spark, "ordered")
    ingest_ordered(stream, path, scratch_path(spark, "ordered-state"), delay="1 day")
    return read_telemetry(spark, path)


def _table_function(call: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql_reports.register_functions(spark, _cleaned(spark, sf_dir))
        return spark.sql(f"SELECT * FROM {call}")

    return run


def _shared_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch_path(spark, "results")
    partial = job.materialize(failures.failures_by_vault_model(_cleaned(spark, sf_dir)), f"{directory}/partial")
    write_result(reports.top_models_from(partial), directory, TOP_MODELS)
    write_result(reports.top_vaults_from(partial), directory, TOP_VAULTS)
    models = read_result(spark, directory, TOP_MODELS).selectExpr("model AS name", "failures_count")
    vaults = read_result(spark, directory, TOP_VAULTS).selectExpr("CAST(vault_id AS STRING) AS name", "failures_count")
    return models.unionByName(vaults)


def _job(name: str, surface: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw_path = scratch_path(spark, "raw")
        _raw(spark, sf_dir).write.parquet(raw_path)
        return job.run(spark, raw_path, scratch_path(spark, "job"), "all", surface)[name]

    return run


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that an evaluation logs, less the times themselves: their number, and whether all took time."""
    raw_path, work_dir = scratch_path(spark, "raw"), scratch_path(spark, "evaluation")
    _raw(spark, sf_dir).write.parquet(raw_path)
    means = job.evaluate(spark, {"parquet": raw_path}, work_dir, runs=2, worker_nodes=1)
    log = read_timing_log(spark, job.log_path(work_dir))
    runs = log.groupBy("query", "format", "worker_nodes").agg(F.count("*").alias("runs"))
    return means.join(runs, ["query", "format", "worker_nodes"]).select(
        "query", "format", "worker_nodes", "runs", (F.col("execution_time") > 0).alias("took_time")
    )


def _near_ranks(collapsed: DataFrame, stats: DataFrame, error: float) -> DataFrame:
    """Whether the ranks of the quartiles in ``stats`` lie within this share of the disks, and one more, of what they should be."""
    names = ", ".join(f"'{name}', `{name}`, {p}D" for name, p in QUARTILES.items())
    marks = stats.selectExpr("failure", f"stack(3, {names}) AS (percentile, mark, p)")
    ranks = collapsed.join(F.broadcast(marks), "failure").groupBy("failure", "percentile", "p").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("s9_power_on_hours") < F.col("mark")).alias("below"),
        F.count_if(F.col("s9_power_on_hours") <= F.col("mark")).alias("up_to"),
    )
    most = 1.0 + F.col("n") * error
    near = (F.col("below") <= F.col("n") * F.col("p") + most) & (F.col("up_to") >= F.col("n") * F.col("p") - most)
    return ranks.select("failure", "percentile", near.alias("within"))


def _within_rank_error(df: DataFrame) -> DataFrame:
    """Whether the ranks of the approximate quartiles, at the shipped accuracy, lie within the promised error."""
    collapsed = disks.disk_collapse(df)
    return _near_ranks(collapsed, percentiles.stats_approx(collapsed), 1.0 / percentiles.ACCURACY)


def _own_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_reports.register_views(spark, _cleaned(spark, sf_dir))
    return spark.sql(
        f"SELECT model, sum(failures_count) AS failures_count FROM {sql_reports.PARTIAL_VIEW} "
        f"WHERE model IN (SELECT model FROM {sql_reports.TELEMETRY_VIEW} WHERE failure) GROUP BY model"
    )


def queries() -> dict[str, Query]:
    return _telemetry_queries() | (corpus.QUERIES if corpus else {})


def _telemetry_queries() -> dict[str, Query]:
    return {
        # Sources and sinks
        "scan_parquet": _raw_roundtrip,
        "scan_mixed_types": _mixed,
        "result_json_committed": _committed,
        "telemetry_roundtrip": _telemetry_roundtrip,
        "telemetry_bucketed": _bucketed,
        "csv_roundtrip": _csv_roundtrip,
        "stream_ingest": _stream_ingest,
        "stream_ordered": _stream_ordered,
        "disk_state_incremental": _disk_state,
        "disk_state_sketches": _disk_state_sketches,
        "failure_counts_incremental": _failure_counts_kept,
        "stream_vault_days": _stream_vault_days,
        "result_json": _on_cleaned(lambda df: to_key_value(reports.top_models(df), TOP_MODELS)),
        "result_json_by_day": _on_cleaned(
            lambda df: to_key_value(reports.vault_days(df), VAULT_DAYS)
        ),
        "timing_log_append": _timing_log_append,
        "shared_partial": _shared_partial,
        # Cleaning
        "drop_nulls": _on_raw(cleaning.drop_nulls),
        "dedup_rows": _on_raw(cleaning.dedup_rows),
        "cast_project": _on_raw(cleaning.cast_project),
        "filter_serial": _on_raw(cleaning.filter_serial),
        "filter_model": _on_raw(cleaning.filter_model),
        "clean": _on_raw(cleaning.clean),
        "clean_raw_dedup": _on_raw(lambda df: cleaning.clean(df, dedup="raw")),
        "clean_all_copies": _on_raw(lambda df: cleaning.clean(df, dedup=None)),
        "clean_strict_ids": _on_raw(lambda df: cleaning.clean(df, strict_ids=True)),
        # Failure counts
        "failed_rows": _on_cleaned(failures.failed_rows),
        "failures_by_day_vault": _on_cleaned(failures.failures_by_day_vault),
        "failures_by_vault_model": _on_cleaned(failures.failures_by_vault_model),
        "failures_by_day_vault_model": _on_cleaned(failures.failures_by_day_vault_model),
        "failures_by_model": _on_cleaned(
            lambda df: failures.failures_by_model(failures.failures_by_vault_model(df))
        ),
        "failures_by_vault": _on_cleaned(
            lambda df: failures.failures_by_vault(failures.failures_by_vault_model(df))
        ),
        "models_per_vault": _on_cleaned(
            lambda df: failures.models_per_vault(failures.failures_by_vault_model(df))
        ),
        "vault_days_2_3_4": _on_cleaned(reports.vault_days),
        "vault_days_from_partial": _on_cleaned(
            lambda df: reports.vault_days_from(failures.failures_by_day_vault_model(df))
        ),
        "top_models": _on_cleaned(reports.top_models),
        "top_models_k4": _on_cleaned(lambda df: reports.top_models(df, 4)),
        "top_vaults": _on_cleaned(reports.top_vaults),
        "top_vaults_k4": _on_cleaned(lambda df: reports.top_vaults(df, 4)),
        "rankings_one_pass": _on_cleaned(reports.rankings),
        # Power-on hours
        "disk_collapse": _on_cleaned(disks.disk_collapse),
        "disk_collapse_bucketed": lambda spark, sf_dir: disks.disk_collapse(_bucketed(spark, sf_dir)),
        "disk_collapse_latest": _on_reset(lambda df: disks.disk_collapse(df, "latest")),
        "hours_min_max_count": _on_cleaned(lambda df: disks.hours_min_max_count(disks.disk_collapse(df))),
        "hours_percentiles_exact": _on_cleaned(
            lambda df: percentiles.percentiles_exact(disks.disk_collapse(df))
        ),
        "hours_percentiles_other": _on_cleaned(
            lambda df: percentiles.percentiles_exact(disks.disk_collapse(df), probs=OTHER_PERCENTILES)
        ),
        "hours_stats": _on_cleaned(reports.hours_stats),
        "hours_stats_latest": _on_reset(lambda df: reports.hours_stats(df, "latest")),
        "hours_stats_approx": _on_cleaned(lambda df: reports.hours_stats_approx(df, accuracy=FINE_ACCURACY)),
        "hours_stats_approx_error": _on_cleaned(_within_rank_error),
        # SQL text
        "sql_views": _own_sql,
        "sql_vault_days": _sql(sql_reports.vault_days_sql),
        "sql_failures_by_vault_model": _sql(sql_reports.partial_sql),
        "sql_top_models": _sql(sql_reports.top_models_sql),
        "sql_top_vaults": _sql(sql_reports.top_vaults_sql),
        "sql_hours_stats": _sql(
            lambda spark, df: sql_reports.hours_stats_sql(spark, df, accuracy=FINE_ACCURACY)
        ),
        "sql_function_vault_days": _table_function("vault_days()"),
        "sql_function_top_models": _table_function("top_models(4)"),
        "sql_function_top_vaults": _table_function("top_vaults(k => 4)"),
        "sql_function_hours_stats": _table_function("hours_stats()"),
        # The whole job, and the run-time harness
        "job_vault_days": _job("query1", "core"),
        "job_top_vaults_sql": _job("sql-query2-2", "sql"),
        "job_hours_stats": _job("query3", "both"),
        "bench_rollup": _on_log(timing.mean_times),
        "bench_totals": _on_log(timing.total_times),
        "evaluation": _evaluation,
    }


# The views in SQL: the same columns, conditions and constants as in spindlewatch/sources/events_view.py.
_VIEWS = """
WITH base AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
         concat(CASE WHEN event_id % 83 = 0 THEN 'sn#' ELSE 'SN-' END, user_id, '_', event_id % 7,
                CASE WHEN event_id % 67 = 0 THEN chr(10) ELSE '' END) AS serial_number,
         CASE WHEN event_id % 97 = 0 THEN NULL
              WHEN event_id % 89 = 0 THEN concat('mdl ', user_id % 25)
              ELSE concat('MDL ', user_id % 25) END AS model,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '1' ELSE '0' END AS failure,
         CASE WHEN event_id % 73 = 0 THEN NULL
              WHEN event_id % 71 = 0 THEN concat(1000 + user_id % 40, '.0')
              ELSE CAST(1000 + user_id % 40 AS VARCHAR) END AS vault_id,
         CASE WHEN event_id % 79 = 0 THEN 'n/a'
              ELSE CAST((user_id * 7919) % 80000 + (event_id % 7) * 331 + (day(ts) - 1) * 24 + hour(ts) AS VARCHAR)
         END AS s9_power_on_hours,
         '1' AS capacity, event_id
  FROM events
), raw AS (
  SELECT * EXCLUDE (event_id) FROM base
  UNION ALL
  SELECT * EXCLUDE (event_id) REPLACE (CASE WHEN event_id % 20 = 0 THEN '2' ELSE '1' END AS capacity)
  FROM base WHERE event_id % 10 = 0
), typed AS (
  SELECT TRY_CAST(date AS DATE) AS event_date, serial_number, model, TRY_CAST(failure AS BOOLEAN) AS failure,
         TRY_CAST(vault_id AS INTEGER) AS vault_id, TRY_CAST(s9_power_on_hours AS DOUBLE) AS s9_power_on_hours
  FROM raw
), distinct_typed AS (
  SELECT TRY_CAST(date AS DATE) AS event_date, serial_number, model, TRY_CAST(failure AS BOOLEAN) AS failure,
         TRY_CAST(vault_id AS INTEGER) AS vault_id, TRY_CAST(s9_power_on_hours AS DOUBLE) AS s9_power_on_hours
  FROM (SELECT DISTINCT * FROM raw)
), copies AS (
  SELECT * FROM typed
  WHERE event_date IS NOT NULL AND failure IS NOT NULL AND vault_id IS NOT NULL AND s9_power_on_hours IS NOT NULL
    AND regexp_full_match(serial_number, '[A-Z0-9_-]+\n?') AND regexp_full_match(model, '[A-Z0-9 ]+\n?')
), cleaned AS (
  SELECT DISTINCT * FROM copies
), reset AS (
  SELECT CAST(ts AS DATE) AS event_date,
         concat('SN-', user_id, '_', event_id % 7) AS serial_number,
         event_type = 'error' AND event_id % 3 = 0 AS failure,
         CAST((user_id * 7919) % 80000 + (event_id % 7) * 331 + (day(ts) - 1) * 24 + hour(ts) AS DOUBLE)
           * CASE WHEN user_id % 5 = 0 AND day(ts) > 20 THEN 0.5 ELSE 1.0 END AS s9_power_on_hours
  FROM events
), log AS (
  SELECT concat('query', user_id % 3 + 1) AS query,
         CASE WHEN event_id % 2 = 0 THEN 'parquet' ELSE 'avro' END AS format,
         CAST(user_id % 4 + 1 AS INTEGER) AS worker_nodes,
         floor(value * 8) / 8 AS execution_time
  FROM events
), disks AS (
  SELECT serial_number, bool_or(failure) AS failure, max(s9_power_on_hours) AS s9_power_on_hours
  FROM cleaned GROUP BY serial_number
), latest AS (
  SELECT serial_number, bool_or(failure) AS failure,
         arg_max(s9_power_on_hours, {'d': event_date, 'h': s9_power_on_hours}) AS s9_power_on_hours
  FROM reset GROUP BY serial_number
), by_day_vault AS (
  SELECT event_date, vault_id, count(*) AS failures_count FROM cleaned WHERE failure GROUP BY ALL
), by_model AS (
  SELECT model, count(*) AS failures_count FROM cleaned WHERE failure GROUP BY ALL
), by_vault AS (
  SELECT vault_id, count(*) AS failures_count, string_agg(DISTINCT model, ',' ORDER BY model) AS list_of_models
  FROM cleaned WHERE failure GROUP BY ALL
)
"""

_VAULT_DAYS = "SELECT * FROM by_day_vault WHERE failures_count IN (2, 3, 4)"
_TOP_MODELS = "SELECT * FROM by_model ORDER BY failures_count DESC, model LIMIT {k}"
_TOP_VAULTS = "SELECT * FROM by_vault ORDER BY failures_count DESC, vault_id LIMIT {k}"
_BY_VAULT_MODEL = "SELECT vault_id, model, count(*) AS failures_count FROM cleaned WHERE failure GROUP BY ALL"

_BY_DAY_VAULT_MODEL = "SELECT event_date, vault_id, model, count(*) AS failures_count FROM cleaned WHERE failure GROUP BY ALL"
_WITHIN = (
    "SELECT failure, percentile, true AS within FROM (SELECT DISTINCT failure FROM disks), "
    f"(VALUES {', '.join(f"('{name}')" for name in QUARTILES)}) AS p(percentile)"
)


def _percentile(p: float) -> str:
    return (
        f"CASE WHEN n * {p} = floor(n * {p}) "
        f"THEN (l[CAST(n * {p} AS BIGINT)] + l[CAST(n * {p} AS BIGINT) + 1]) / 2 "
        f"ELSE l[CAST(floor(n * {p}) AS BIGINT) + 1] END"
    )


def _stats_sql(table: str, columns: str) -> str:
    return (
        f"SELECT {columns} FROM (SELECT failure, count(*) AS n, list(s9_power_on_hours ORDER BY s9_power_on_hours) AS l "
        f"FROM {table} GROUP BY failure)"
    )


_OTHER = ", ".join(f'{_percentile(p)} AS "{name}"' for name, p in OTHER_PERCENTILES.items())
_QUARTILES = ", ".join(f'{_percentile(p)} AS "{name}"' for name, p in QUARTILES.items())
_STATS = f"CAST(failure AS INTEGER) AS failure, l[1] AS min, {_QUARTILES}, l[n] AS max, n AS count"
_DISCRETE = ", ".join(
    f'quantile_disc(s9_power_on_hours, {p}) AS "{name}"' for name, p in QUARTILES.items()
)
_STATS_APPROX = (
    f"SELECT CAST(failure AS INTEGER) AS failure, min(s9_power_on_hours) AS min, {_DISCRETE}, "
    "max(s9_power_on_hours) AS max, count(*) AS count FROM disks GROUP BY failure"
)


_JSON_BY_DAY = (
    "SELECT concat('query1/', event_date) AS key, CAST(to_json(list({'event_date': CAST(event_date AS VARCHAR), "
    "'vault_id': vault_id, 'failures_count': failures_count} ORDER BY vault_id)) AS VARCHAR) AS value "
    f"FROM ({_VAULT_DAYS}) GROUP BY event_date"
)


def oracle_sql() -> dict[str, str]:
    bodies = {
        "scan_parquet": "SELECT * FROM raw",
        "scan_mixed_types": "SELECT * FROM cleaned",
        "telemetry_roundtrip": "SELECT * FROM cleaned",
        "telemetry_bucketed": "SELECT * FROM cleaned",
        "csv_roundtrip": _TOP_VAULTS.format(k=10),
        "stream_ingest": "SELECT * FROM cleaned",
        "stream_ordered": "SELECT * FROM cleaned",
        "disk_state_incremental": (
            "SELECT serial_number, bool_or(failure) AS failure, max(s9_power_on_hours) AS s9_power_on_hours, "
            "arg_max(s9_power_on_hours, {'d': event_date, 'h': s9_power_on_hours}) AS latest_hours FROM cleaned GROUP BY serial_number"
        ),
        "disk_state_sketches": _WITHIN,
        "failure_counts_incremental": _BY_DAY_VAULT_MODEL,
        "stream_vault_days": _VAULT_DAYS,
        "result_json": (
            "SELECT 'query2-1' AS key, CAST(to_json(list({'model': model, 'failures_count': failures_count} "
            "ORDER BY failures_count DESC, model)) AS VARCHAR) AS value "
            f"FROM ({_TOP_MODELS.format(k=10)})"
        ),
        "result_json_by_day": _JSON_BY_DAY,
        "result_json_committed": _JSON_BY_DAY,
        "timing_log_append": "SELECT * FROM log",
        "shared_partial": (
            f"SELECT model AS name, failures_count FROM ({_TOP_MODELS.format(k=10)}) UNION ALL "
            f"SELECT CAST(vault_id AS VARCHAR), failures_count FROM ({_TOP_VAULTS.format(k=10)})"
        ),
        "evaluation": (
            "SELECT concat(p, q) AS query, 'parquet' AS format, 1 AS worker_nodes, CAST(2 AS BIGINT) AS runs, true AS took_time "
            "FROM (VALUES (''), ('sql-')) AS a(p), (VALUES ('failure_counts'), ('query1'), ('query2'), ('query3')) AS b(q)"
        ),
        "drop_nulls": "SELECT * FROM raw WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in RAW_COLUMNS),
        "dedup_rows": "SELECT DISTINCT * FROM raw",
        "cast_project": "SELECT * FROM typed",
        "filter_serial": "SELECT * FROM raw WHERE regexp_full_match(serial_number, '[A-Z0-9_-]+\\n?')",
        "filter_model": "SELECT * FROM raw WHERE regexp_full_match(model, '[A-Z0-9 ]+')",
        "clean": "SELECT * FROM cleaned",
        "clean_raw_dedup": (
            "SELECT * FROM distinct_typed WHERE event_date IS NOT NULL AND failure IS NOT NULL AND vault_id IS NOT NULL "
            "AND s9_power_on_hours IS NOT NULL AND regexp_full_match(serial_number, '[A-Z0-9_-]+\\n?') "
            "AND regexp_full_match(model, '[A-Z0-9 ]+')"
        ),
        "clean_all_copies": "SELECT * FROM copies",
        "clean_strict_ids": "SELECT * FROM cleaned WHERE regexp_full_match(serial_number, '[A-Z0-9_-]+')",
        "failed_rows": "SELECT * FROM cleaned WHERE failure",
        "failures_by_day_vault": "SELECT * FROM by_day_vault",
        "failures_by_vault_model": _BY_VAULT_MODEL,
        "failures_by_day_vault_model": _BY_DAY_VAULT_MODEL,
        "failures_by_model": "SELECT * FROM by_model",
        "failures_by_vault": "SELECT vault_id, failures_count FROM by_vault",
        "models_per_vault": "SELECT vault_id, list_of_models FROM by_vault",
        "vault_days_2_3_4": _VAULT_DAYS,
        "vault_days_from_partial": _VAULT_DAYS,
        "top_models": _TOP_MODELS.format(k=10),
        "top_models_k4": _TOP_MODELS.format(k=4),
        "top_vaults": _TOP_VAULTS.format(k=10),
        "top_vaults_k4": _TOP_VAULTS.format(k=4),
        "rankings_one_pass": (
            "SELECT 'model' AS ranking, CAST(row_number() OVER (ORDER BY failures_count DESC, model) AS INTEGER) AS place, model AS name, "
            f"failures_count, CAST(NULL AS VARCHAR) AS list_of_models FROM ({_TOP_MODELS.format(k=10)}) UNION ALL "
            "SELECT 'vault', CAST(row_number() OVER (ORDER BY failures_count DESC, vault_id) AS INTEGER), CAST(vault_id AS VARCHAR), "
            f"failures_count, list_of_models FROM ({_TOP_VAULTS.format(k=10)})"
        ),
        "disk_collapse": "SELECT * FROM disks",
        "disk_collapse_bucketed": "SELECT * FROM disks",
        "disk_collapse_latest": "SELECT * FROM latest",
        "hours_min_max_count": (
            "SELECT CAST(failure AS INTEGER) AS failure, min(s9_power_on_hours) AS min, max(s9_power_on_hours) AS max, "
            "count(*) AS count FROM disks GROUP BY failure"
        ),
        "hours_percentiles_exact": _stats_sql("disks", f"failure, {_QUARTILES}"),
        "hours_percentiles_other": _stats_sql("disks", f"failure, {_OTHER}"),
        "hours_stats": _stats_sql("disks", _STATS),
        "hours_stats_latest": _stats_sql("latest", _STATS),
        "hours_stats_approx": _STATS_APPROX,
        "hours_stats_approx_error": _WITHIN,
        "sql_views": "SELECT * FROM by_model",
        "sql_vault_days": _VAULT_DAYS,
        "sql_failures_by_vault_model": _BY_VAULT_MODEL,
        "sql_top_models": _TOP_MODELS.format(k=10),
        "sql_top_vaults": _TOP_VAULTS.format(k=10),
        "sql_hours_stats": _STATS_APPROX,
        "sql_function_vault_days": _VAULT_DAYS,
        "sql_function_top_models": _TOP_MODELS.format(k=4),
        "sql_function_top_vaults": _TOP_VAULTS.format(k=4),
        "sql_function_hours_stats": _stats_sql("disks", _STATS),
        "job_vault_days": _VAULT_DAYS,
        "job_top_vaults_sql": _TOP_VAULTS.format(k=10),
        "job_hours_stats": _stats_sql("disks", _STATS),
        "bench_rollup": (
            "SELECT query, format, worker_nodes, avg(execution_time) AS execution_time FROM log GROUP BY ALL"
        ),
        "bench_totals": "SELECT query, sum(execution_time) AS execution_time FROM log GROUP BY ALL",
    }
    return {name: _VIEWS + body for name, body in bodies.items()} | (corpus.ORACLES if corpus else {})
