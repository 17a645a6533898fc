from spindlewatch.operators import failures as ops
from spindlewatch.plans import reports, sql_reports
from tests.helpers import day, failures, telemetry


def test_vault_days_with_two_to_four_failures(spark):
    df = failures(spark, {(1, "A", 10 + n): n for n in range(1, 6)}).unionByName(
        telemetry(spark, [(2, f"SN-{i}", "A", False, 11, 1.0) for i in range(3)])
    )
    expected = [(day(1), 12, 2), (day(1), 13, 3), (day(1), 14, 4)]
    assert reports.vault_days(df).collect() == expected
    assert reports.vault_days_from(ops.failures_by_day_vault_model(df)).collect() == expected
    assert sql_reports.vault_days_sql(spark, df).collect() == expected
    assert reports.vault_days(df, counts=(5,)).collect() == [(day(1), 15, 5)]
    assert sql_reports.vault_days_sql(spark, df, counts=(5,)).collect() == [(day(1), 15, 5)]


def test_vault_days_order_and_mixed_models(spark):
    df = failures(spark, {(2, "A", 1): 1, (2, "B", 1): 1, (1, "A", 2): 2, (1, "A", 1): 2})
    expected = [(day(1), 1, 2), (day(1), 2, 2), (day(2), 1, 2)]
    assert reports.vault_days(df).collect() == expected
    assert sql_reports.vault_days_sql(spark, df).collect() == expected


def test_no_failures_give_empty_results(spark):
    df = telemetry(spark, [(1, "SN-1", "A", False, 1, 1.0)])
    for report in (reports.vault_days, reports.top_models, reports.top_vaults):
        assert report(df).collect() == []


def test_ties_at_the_cut_fall_by_name(spark):
    models = {f"M{i:02}": 20 - i for i in range(8)} | {f"M{i:02}": 5 for i in (11, 10, 9, 8)}
    df = failures(spark, {(1, model, 100 + i): n for i, (model, n) in enumerate(models.items())})
    expected = sorted(models.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert reports.top_models(df).collect() == expected
    assert sql_reports.top_models_sql(spark, df).collect() == expected


def test_ties_between_vaults_fall_by_number(spark):
    counts = {100 + i: 20 - i for i in range(8)} | {i: 5 for i in (211, 210, 209, 208)}
    df = failures(spark, {(1, "A", vault): n for vault, n in counts.items()})
    expected = [(v, n, "A") for v, n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]]
    assert reports.top_vaults(df).collect() == expected
    assert sql_reports.top_vaults_sql(spark, df).collect() == expected


def test_model_lists_are_distinct_and_sorted(spark):
    df = failures(spark, {(1, "C", 1): 1, (2, "B", 1): 1, (3, "A", 1): 1, (1, "D", 2): 1, (2, "D", 2): 1})
    expected = [(1, 3, "A,B,C"), (2, 2, "D")]
    partial = ops.failures_by_vault_model(df)
    assert reports.top_vaults(df).collect() == expected
    assert reports.top_vaults_from(ops.failures_by_day_vault_model(df)).collect() == expected
    assert sql_reports.top_vaults_sql(spark, df).collect() == expected
    assert sorted(ops.models_per_vault(partial).collect()) == [(1, "A,B,C"), (2, "D")]


def test_rankings_without_a_cut_add_up_to_all_failures(spark):
    df = failures(spark, {(d, m, v): d + v for d in (1, 2) for m in "AB" for v in (1, 2, 3)})
    total = ops.failed_rows(df).count()
    for report in (reports.top_models, reports.top_vaults):
        assert sum(r.failures_count for r in report(df, 1000).collect()) == total
