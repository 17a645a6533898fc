import json

import pytest

from spindlewatch.plans import job, reports, sql_reports
from spindlewatch.plans.timing import session_workers
from spindlewatch.operators.cleaning import clean
from spindlewatch.schema import REPORTS
from spindlewatch.shared import scratch_path
from spindlewatch.sources.events_view import raw_telemetry, read_events
from spindlewatch.sources.tables import read_timing_log

SF_DIR = "/root/testdata/sf0.01"
RUNS = {f"{p}{q}" for p in ("", "sql-") for q in ("failure_counts", "query1", "query2", "query3")}
NAMES = {"query1", "query2-1", "query2-2", "query3"}


@pytest.fixture(scope="module")
def raw_path(spark):
    path = scratch_path(spark, "raw")
    raw_telemetry(read_events(spark, SF_DIR)).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def cleaned(spark, raw_path):
    return clean(spark.read.parquet(raw_path)).persist()


def test_all_reports_on_both_surfaces(spark, raw_path, cleaned, tmp_path):
    log = f"{tmp_path}/evaluation.csv"
    results = job.run(spark, raw_path, str(tmp_path), surface="both", timings_path=log, worker_nodes=8)
    assert set(results) == NAMES | {f"sql-{n}" for n in NAMES}
    assert results["query1"].collect() == reports.vault_days(cleaned).collect()
    assert results["query2-1"].collect() == reports.top_models(cleaned).collect()
    assert results["query2-2"].collect() == reports.top_vaults(cleaned).collect()
    assert results["query3"].collect() == reports.hours_stats(cleaned).collect()
    assert results["sql-query3"].collect() == reports.hours_stats_approx(cleaned).collect()
    for name in ("query1", "query2-1", "query2-2"):
        assert results[name].collect() == results[f"sql-{name}"].collect()
    runs = read_timing_log(spark, log).collect()
    assert {r.query for r in runs} == RUNS
    assert {(r.format, r.worker_nodes) for r in runs} == {("parquet", 8)}

    pairs = {k: json.loads(v) for k, v in job.key_values(results).collect()}
    assert {k.split("/")[0] for k in pairs} == set(results)
    assert len(pairs["query2-1"]) == 10
    days = [row for k in sorted(pairs) if k.startswith("query1/") for row in pairs[k]]
    assert [tuple(row.values()) for row in days] == [
        (str(r.event_date), r.vault_id, r.failures_count) for r in reports.vault_days(cleaned).collect()
    ]


@pytest.mark.parametrize("query, names", [("1", {"query1"}), ("2", {"query2-1", "query2-2"}), ("3", {"query3"})])
def test_one_query(spark, raw_path, tmp_path, query, names):
    job.prepare(spark, raw_path, f"{tmp_path}/clean", cluster_by=None)
    results = job.process(spark, f"{tmp_path}/clean", f"{tmp_path}/out", query)
    assert set(results) == names
    for name, df in results.items():
        assert df.schema.names == REPORTS[name].schema.names
        assert df.count() > 0


def test_unknown_selections(spark, tmp_path):
    with pytest.raises(ValueError):
        job.process(spark, str(tmp_path), str(tmp_path), "4")
    with pytest.raises(ValueError):
        job.process(spark, str(tmp_path), str(tmp_path), "1", "rdd")


def test_failure_reports_share_one_scan(spark, raw_path, tmp_path):
    job.run(spark, raw_path, str(tmp_path), "all")
    partial = spark.read.parquet(f"{tmp_path}/results/failure_counts.parquet")
    assert partial.columns == ["event_date", "vault_id", "model", "failures_count"]
    assert "preprocessed" not in reports.top_models_from(partial)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("core, sql", [
    (reports.vault_days, sql_reports.vault_days_sql),
    (reports.top_models, sql_reports.top_models_sql),
    (reports.top_vaults, sql_reports.top_vaults_sql),
    (reports.hours_stats_approx, sql_reports.hours_stats_sql),
])
def test_surfaces_agree(spark, cleaned, core, sql):
    a, b = core(cleaned), sql(spark, cleaned)
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    assert a.collect() == b.collect()
    name = {"vault_days": "query1", "top_models": "query2-1", "top_vaults": "query2-2"}.get(core.__name__, "query3")
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in REPORTS[name].schema]


def test_evaluation(spark, raw_path, tmp_path):
    means = job.evaluate(spark, {"parquet": raw_path}, str(tmp_path), runs=2, worker_nodes=4).collect()
    assert [r.query for r in means] == sorted(RUNS)
    log = read_timing_log(spark, job.log_path(str(tmp_path))).collect()
    assert len(log) == 16
    for row in means:
        assert (row.format, row.worker_nodes) == ("parquet", 4)
        runs = [r.execution_time for r in log if r.query == row.query]
        assert row.execution_time == pytest.approx(sum(runs) / 2)


def test_a_query_alone_is_charged_for_its_partial(spark, raw_path, tmp_path):
    job.prepare(spark, raw_path, f"{tmp_path}/clean")
    log = f"{tmp_path}/log"
    job.process(spark, f"{tmp_path}/clean", f"{tmp_path}/out", "2", "both", timings_path=log)
    assert {(r.query, r.worker_nodes) for r in read_timing_log(spark, log).collect()} == {("query2", 1), ("sql-query2", 1)}


@pytest.mark.parametrize("conf, workers", [
    ({"spark.master": "local[8]"}, 1), ({"spark.master": "local-cluster[3,2,1024]"}, 3),
    ({"spark.master": "yarn", "spark.executor.instances": "40"}, 40), ({}, 1),
])
def test_workers_come_from_the_session(conf, workers):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: conf_of.get(key, default))

    conf_of = conf
    assert session_workers(Session) == workers
