"""The batch job: clean once, then any selection of reports, on either surface, in either format."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from spindlewatch.operators.cleaning import clean, clean_groups
from spindlewatch.operators.failures import failures_by_day_vault_model, failures_by_vault_model
from spindlewatch.plans import reports, sql_reports
from spindlewatch.plans.timing import mean_times, session_workers, timed
from spindlewatch.schema import AVERAGES, HOURS_STATS, REPORTS, TOP_MODELS, TOP_VAULTS, VAULT_DAYS, Report
from spindlewatch.sinks.key_value import to_key_value
from spindlewatch.sinks.tables import write_bucketed, write_result, write_telemetry
from spindlewatch.sinks.timing_log import append_timings, timing_frame
from spindlewatch.sources.mixed import read_raw_groups
from spindlewatch.sources.tables import read_bucketed, read_raw, read_result, read_telemetry, read_timing_log

# Query selectors, the queries' names and the reports each one writes.
QUERIES = {
    "1": ("query1", (VAULT_DAYS,)),
    "2": ("query2", (TOP_MODELS, TOP_VAULTS)),
    "3": ("query3", (HOURS_STATS,)),
}
SURFACES = ("core", "sql", "both")
SQL_PREFIX = "sql-"
# What the run-time log calls the work that the queries of a run share.
SHARED = "failure_counts"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate result that several actions read, and return what was written.

    Unlike cached blocks, the table outlives any executor, and adaptive execution sizes its files: a cached frame
    keeps one block per shuffle partition, however small.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(
    spark: SparkSession,
    raw_path: str,
    clean_path: str,
    fmt: str = "parquet",
    dedup: str | None = "projected",
    cluster_by: str | None = None,
    buckets: int | None = None,
    mixed: bool = False,
) -> DataFrame:
    """Clean the raw table into ``clean_path`` and return what was written there.

    ``mixed`` admits parquet files whose columns differ in type (:func:`spindlewatch.sources.mixed.read_raw_groups`).

    The layout is plain unless ``cluster_by`` (:func:`spindlewatch.sinks.tables.write_telemetry`) or, for parquet,
    ``buckets`` (:func:`spindlewatch.sinks.tables.write_bucketed`) asks for another, which cost a shuffle and pay for large
    tables that are reported on repeatedly.
    """
    if buckets is not None and (fmt != "parquet" or cluster_by):
        raise ValueError("a bucketed table is parquet, without cluster_by")
    if mixed and fmt != "parquet":
        raise ValueError("files of several types must be parquet")
    cleaned = clean_groups(read_raw_groups(spark, raw_path), dedup) if mixed else clean(read_raw(spark, raw_path, fmt), dedup)
    if buckets is None:
        write_telemetry(cleaned, clean_path, fmt, cluster_by=cluster_by)
    else:
        write_bucketed(cleaned, clean_path, buckets)
    return _cleaned(spark, clean_path, fmt, buckets)


def _cleaned(spark: SparkSession, clean_path: str, fmt: str, buckets: int | None) -> DataFrame:
    return read_telemetry(spark, clean_path, fmt) if buckets is None else read_bucketed(spark, clean_path, buckets)


def _core(df: DataFrame, query: str, partial_path: str) -> dict[str, Callable[[], DataFrame]]:
    """What each report reads, and under SHARED the partial that several of them read."""

    @cache
    def partial() -> DataFrame:
        counts = failures_by_day_vault_model(df) if query == "all" else failures_by_vault_model(df)
        return materialize(counts, partial_path)

    return {
        VAULT_DAYS.name: lambda: reports.vault_days_from(partial()) if query == "all" else reports.vault_days(df),
        TOP_MODELS.name: lambda: reports.top_models_from(partial()),
        TOP_VAULTS.name: lambda: reports.top_vaults_from(partial()),
        HOURS_STATS.name: lambda: reports.hours_stats(df),
        SHARED: partial,
    }


def _sql(spark: SparkSession, df: DataFrame, partial_path: str) -> dict[str, Callable[[], DataFrame]]:
    @cache
    def partial() -> DataFrame:
        return materialize(sql_reports.partial_sql(spark, df), partial_path)

    return {
        VAULT_DAYS.name: lambda: sql_reports.vault_days_sql(spark, df),
        TOP_MODELS.name: lambda: sql_reports.top_models_sql_from(spark, partial()),
        TOP_VAULTS.name: lambda: sql_reports.top_vaults_sql_from(spark, partial()),
        HOURS_STATS.name: lambda: sql_reports.hours_stats_sql(spark, df),
        SHARED: partial,
    }


def process(
    spark: SparkSession,
    clean_path: str,
    out_dir: str,
    query: str = "all",
    surface: str = "core",
    fmt: str = "parquet",
    timings_path: str | None = None,
    worker_nodes: int | None = None,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Write the selected reports below ``out_dir`` and return the written results by name.

    The failure reports share one small partial, the failures per (day, vault, model), written beside the results, so
    that they scan the table once between them. ``timings_path`` appends one row per query to the run-time log, from
    scan to written result. With ``query="all"`` the partial has a row of its own there, so that no query is charged
    for what others read as well; a query that runs alone is charged for its partial. ``worker_nodes`` is the session's
    number of executors unless given. ``buckets`` says that the cleaned table is bucketed.
    """
    worker_nodes = worker_nodes or session_workers(spark)
    if query != "all" and query not in QUERIES:
        raise ValueError(f"query must be one of {', '.join(QUERIES)} or all, not {query!r}")
    if surface not in SURFACES:
        raise ValueError(f"surface must be one of {', '.join(SURFACES)}, not {surface!r}")
    df = _cleaned(spark, clean_path, fmt, buckets)
    selected = list(QUERIES.values()) if query == "all" else [QUERIES[query]]
    written: dict[str, Report] = {}
    timings: list[tuple[str, str, int, float]] = []

    def write(frames: Mapping[str, Callable[[], DataFrame]], prefix: str) -> None:
        if query == "all":
            timings.append((prefix + SHARED, fmt, worker_nodes, timed(frames[SHARED])))
        for name, query_reports in selected:
            seconds = 0.0
            for base in query_reports:
                report = base.renamed(prefix + base.name)
                seconds += timed(lambda: write_result(frames[base.name](), out_dir, report))
                written[report.name] = report
            timings.append((prefix + name, fmt, worker_nodes, seconds))

    if surface in ("core", "both"):
        write(_core(df, query, f"{out_dir}/failure_counts.parquet"), "")
    if surface in ("sql", "both"):
        write(_sql(spark, df, f"{out_dir}/{SQL_PREFIX}failure_counts.parquet"), SQL_PREFIX)
    if timings_path:
        append_timings(timing_frame(spark, timings), timings_path)
    return {name: read_result(spark, out_dir, report) for name, report in written.items()}


def run(
    spark: SparkSession,
    raw_path: str,
    work_dir: str,
    query: str = "all",
    surface: str = "core",
    fmt: str = "parquet",
    cluster_by: str | None = None,
    buckets: int | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Clean, then report: :func:`prepare` into ``work_dir/preprocessed.<fmt>``, :func:`process` into its results."""
    clean_path = f"{work_dir}/preprocessed.{fmt}"
    prepare(spark, raw_path, clean_path, fmt, cluster_by=cluster_by, buckets=buckets)
    return process(spark, clean_path, f"{work_dir}/results", query, surface, fmt, buckets=buckets, **options)


def key_values(results: Mapping[str, DataFrame]) -> DataFrame:
    """All results of a run as one key/value frame."""
    frames = []
    for name, df in results.items():
        report = REPORTS[name.removeprefix(SQL_PREFIX)].renamed(name)
        frames.append(to_key_value(df, report))
    pairs = frames[0]
    for frame in frames[1:]:
        pairs = pairs.unionByName(frame)
    return pairs


def log_path(work_dir: str) -> str:
    """The run-time log of an evaluation in ``work_dir``."""
    return f"{work_dir}/evaluation.csv"


def evaluate(
    spark: SparkSession,
    raw_paths: Mapping[str, str],
    work_dir: str,
    runs: int = 10,
    worker_nodes: int | None = None,
) -> DataFrame:
    """Run all reports on both surfaces ``runs`` times per format, log every run, and write and return the means.

    ``raw_paths`` maps a format to the raw table in it. Each run reads the cleaned table anew; nothing is cached
    between runs.
    """
    log = log_path(work_dir)
    for fmt, raw_path in raw_paths.items():
        clean_path = f"{work_dir}/preprocessed.{fmt}"
        prepare(spark, raw_path, clean_path, fmt)
        for _ in range(runs):
            process(
                spark, clean_path, f"{work_dir}/results", "all", "both", fmt,
                timings_path=log, worker_nodes=worker_nodes,
            )
    write_result(mean_times(read_timing_log(spark, log)), work_dir, AVERAGES)
    return read_result(spark, work_dir, AVERAGES)
