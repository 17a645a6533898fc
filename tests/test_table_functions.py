import random

import pytest

from spindlewatch.plans import reports, sql_reports
from tests.helpers import failures, plan_text, telemetry


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_quartiles_equal_the_dataframe_surface(spark, seed, monkeypatch):
    rng = random.Random(seed)
    df = telemetry(spark, [
        (1, f"SN-{i}", "M", rng.random() < 0.3, 7, float(rng.choice([rng.randrange(20), rng.random() * 1000, -5.5])))
        for i in range(rng.choice([1, 2, 4, 37, 400, 3000]))
    ])
    sql_reports.register_functions(spark, df)
    assert sorted(spark.sql("SELECT * FROM hours_stats()").collect()) == sorted(reports.hours_stats(df).collect())


def test_parameters_and_defaults(spark):
    groups = {(d, f"M{m}", 10 + v): (d + m * v) % 5 for d in range(1, 4) for m in range(12) for v in range(12)}
    df = failures(spark, groups)
    sql_reports.register_functions(spark, df)
    for k in (1, 4, 10):
        assert sorted(spark.sql(f"SELECT * FROM top_vaults({k})").collect()) == sorted(reports.top_vaults(df, k).collect())
        assert sorted(spark.sql(f"SELECT * FROM top_models(k => {k})").collect()) == sorted(reports.top_models(df, k).collect())
    assert sorted(spark.sql("SELECT * FROM top_models()").collect()) == sorted(reports.top_models(df).collect())
    assert sorted(spark.sql("SELECT * FROM vault_days(array(20, 21, 26))").collect()) == sorted(reports.vault_days(df, (20, 21, 26)).collect())


def test_a_top_k_is_a_bounded_heap(spark):
    sql_reports.register_functions(spark, failures(spark, {(1, "A", 7): 2, (1, "B", 8): 1}))
    assert "TakeOrderedAndProject" in plan_text(spark.sql("SELECT * FROM top_vaults(1)"))


def test_both_rankings_from_one_aggregate(spark):
    groups = {(d, f"M{m}", 10 + v): (d + m * v) % 4 for d in range(1, 3) for m in range(15) for v in range(13)}
    df = failures(spark, groups)
    both = reports.rankings(df, 5)
    rows = sorted(both.collect())
    assert [(r.name, r.failures_count) for r in rows if r.ranking == "model"] == [tuple(r) for r in reports.top_models(df, 5).collect()]
    assert [(int(r.name), r.failures_count, r.list_of_models) for r in rows if r.ranking == "vault"] == [
        tuple(r) for r in reports.top_vaults(df, 5).collect()
    ]
    plan = plan_text(both)
    assert "Expand" in plan and "WindowGroupLimit" in plan


def test_empty_telemetry(spark):
    df = telemetry(spark, [])
    sql_reports.register_functions(spark, df)
    for call in ("vault_days()", "top_models()", "top_vaults()", "hours_stats()"):
        assert spark.sql(f"SELECT * FROM {call}").count() == 0
    assert reports.rankings(df).count() == 0
