"""What the plans must and must not contain."""

import re

import pytest

import __spark_entry__ as contract
from spindlewatch.operators.cleaning import clean
from spindlewatch.plans import reports, sql_reports
from spindlewatch.shared import scratch_path
from spindlewatch.sinks.tables import write_telemetry
from spindlewatch.sources.events_view import raw_telemetry, read_events
from spindlewatch.sources.tables import read_telemetry
from tests.helpers import plan_text

SF_DIR = "/root/testdata/sf0.01"


def write_once(spark, **layout):
    path = scratch_path(spark, "plans")
    write_telemetry(clean(raw_telemetry(read_events(spark, SF_DIR))), path, **layout)
    return read_telemetry(spark, path)


@pytest.fixture(scope="module")
def table(spark):
    return write_once(spark)


@pytest.fixture(scope="module")
def flat(spark):
    return write_once(spark, partition_by=())


def exchanges(plan):
    """Kind and keys of each shuffle that ran; reused ones ran once."""
    final = plan.split("== Initial Plan ==")[0]
    own = re.sub(r"ReusedExchange \[[^\]]*\], \w*Exchange", "Reused", final)
    return re.findall(r"(?<!Broadcast)Exchange (\w+)\(([^)]*)\)", own)


FAILURE_REPORTS = [reports.vault_days, reports.top_models, reports.top_vaults]


@pytest.mark.parametrize("report", FAILURE_REPORTS)
def test_failure_reports_read_the_failed_files_and_needed_columns_only(table, report):
    plan = plan_text(report(table))
    assert re.search(r"PartitionFilters: \[[^\]]*failure", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "serial_number" not in schema and "s9_power_on_hours" not in schema


@pytest.mark.parametrize("report", FAILURE_REPORTS)
def test_failure_predicate_reaches_the_scan_of_an_unpartitioned_table(flat, report):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(failure,true\)", plan_text(report(flat)))


@pytest.mark.parametrize("report", [reports.top_models, reports.top_vaults])
def test_rankings_are_bounded_heaps(table, report):
    plan = plan_text(report(table))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_counts_are_combined_before_each_shuffle(table):
    plan = plan_text(reports.vault_days(table))
    assert "partial_count" in plan


def test_hours_report_shuffles_the_disks_once(table):
    plan = plan_text(reports.hours_stats(table))
    keys = [k for kind, k in exchanges(plan) if kind == "hashpartitioning"]
    assert sum("serial_number" in k for k in keys) == 1
    assert len(re.findall(r"FileScan", plan.split("== Initial Plan ==")[0])) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "model" not in schema and "vault_id" not in schema


def test_collapse_is_a_hash_aggregate(table):
    plan = plan_text(reports.hours_stats_approx(table))
    assert "SortAggregate" not in plan


def test_sql_text_plans_like_the_dataframe(spark, table):
    plan = plan_text(sql_reports.top_vaults_sql(spark, table))
    assert "TakeOrderedAndProject" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*failure", plan)


def test_cleaning_shuffles_once_and_combines_copies_first(spark):
    plan = plan_text(clean(raw_telemetry(read_events(spark, SF_DIR))))
    assert len(exchanges(plan)) == 1
    final = plan.split("== Initial Plan ==")[0]
    before = final.split("Exchange hashpartitioning")[1]
    assert "HashAggregate" in before
    assert "RLIKE" in before


@pytest.mark.parametrize("name", sorted(contract._telemetry_queries()))
def test_no_python_and_no_cross_join(spark, name):
    df = contract._telemetry_queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
