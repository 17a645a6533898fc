import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spindlewatch.functions.percentiles import percentiles_exact, stats_approx, stats_exact
from spindlewatch.schema import QUARTILES

SCHEMA = "failure boolean, s9_power_on_hours double"


def defined(numbers, p):
    """The inverse of the empirical distribution at ``p``: the mean of the least number whose cumulative share reaches
    ``p`` and the least whose share exceeds it. ``p`` is the decimal it is written as."""
    wanted, shares, seen = Fraction(str(p)), {}, 0
    for number, times in sorted(Counter(numbers).items()):
        seen += times
        shares[number] = Fraction(seen, len(numbers))
    reached = min(number for number, share in shares.items() if share >= wanted)
    exceeded = min(number for number, share in shares.items() if share > wanted)
    return (reached + exceeded) / 2 if reached != exceeded else reached


def frame(spark, groups):
    return spark.createDataFrame([(flag, v) for flag, values in groups.items() for v in values], SCHEMA)


def expected(groups):
    return {
        flag: (min(values), *[defined(values, p) for p in QUARTILES.values()], max(values), len(values))
        for flag, values in groups.items()
    }


def check(spark, groups, **options):
    rows = stats_exact(frame(spark, groups), **options).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == expected(groups)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 100, 101])
def test_group_sizes(spark, n):
    check(spark, {True: [float(i * i) for i in range(n)], False: [float(-i) for i in range(n + 1)]})


def test_equal_values(spark):
    check(spark, {True: [5.0] * 40, False: [1.0] * 30 + [2.0] * 10})


def test_one_flag_only(spark):
    check(spark, {True: [3.0, 1.0, 2.0]})


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.lists(st.floats(-1e6, 1e6), min_size=1))
def test_any_values(spark, whole, real):
    check(spark, {True: [float(v) for v in whole], False: [v + 0.0 for v in real]})


def test_result_does_not_depend_on_where_the_fences_lie(spark):
    values = random.Random(1).sample(range(100_000), 20_000)
    groups = {True: [float(v) for v in values], False: [float(v) ** 3 for v in values[:5_001]]}
    for accuracy in (2, 10, 100, 10_000, 1_000_000):
        check(spark, groups, accuracy=accuracy)


def test_one_value_holding_a_third_of_all_rows(spark):
    spread = [float(v) for v in random.Random(2).sample(range(1_000_000), 20_000)]
    check(spark, {True: [777_777.0] * 10_000 + spread[:5_000], False: spread})


def test_rows_without_a_value_or_flag(spark):
    df = spark.createDataFrame(
        [(True, 1.0), (True, None), (True, 3.0), (False, None), (None, 9.0), (None, 4.0)], SCHEMA
    )
    assert {r[0]: tuple(r[1:]) for r in stats_exact(df).collect()} == {
        True: (1.0, 1.0, 2.0, 3.0, 3.0, 3),
        False: (None, None, None, None, None, 1),
        None: (4.0, 4.0, 6.5, 9.0, 9.0, 2),
    }


def test_other_probabilities(spark):
    values = [float(v) for v in range(1, 1_002)]
    row = percentiles_exact(frame(spark, {True: values}), probs={"p1": 0.01, "p99": 0.99, "p999": 0.999}).first()
    assert (row.p1, row.p99, row.p999) == tuple(defined(values, p) for p in (0.01, 0.99, 0.999)) == (11.0, 991.0, 1000.0)


def test_ranks_are_decimal(spark):
    """Products of these and 100 are whole, which binary fractions miss."""
    values = [float(v) for v in range(1, 101)]
    probs = {f"p{int(100 * p + 0.5)}": p for p in (0.07, 0.14, 0.28, 0.29, 0.55)}
    row = percentiles_exact(frame(spark, {True: values}), probs=probs).first()
    assert tuple(row)[1:] == (7.5, 14.5, 28.5, 29.5, 55.5)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 400), st.lists(st.integers(1, 9999), min_size=1, max_size=4, unique=True))
def test_any_probabilities_and_sizes(spark, n, parts):
    values = [float(v * v % 101) for v in range(n)]
    probs = {f"p{k}": k / 10_000 for k in parts}
    row = percentiles_exact(frame(spark, {False: values}), probs=probs).first()
    assert tuple(row)[1:] == tuple(defined(values, p) for p in probs.values())


def test_one_sketch_serves_counts_and_ranks(spark):
    """Without reuse of shuffles the sketch is not computed a second time for the ranking."""
    values = [float(v) for v in random.Random(4).sample(range(100_000), 3_000)]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        check(spark, {True: values, False: values[:77]}, accuracy=50)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_rejects_what_it_cannot_bound(spark):
    df = spark.createDataFrame([("a", 1.0)], "failure string, s9_power_on_hours double")
    with pytest.raises(TypeError):
        stats_exact(df)
    with pytest.raises(ValueError):
        stats_exact(frame(spark, {True: [1.0]}), probs={"top": 1.0})
    with pytest.raises(ValueError, match="decimals"):
        stats_exact(frame(spark, {True: [1.0]}), probs={"fine": 1e-20})
    with pytest.raises(TypeError):
        stats_approx(df)


def test_approximate_rank_error_is_bounded(spark):
    rng = random.Random(3)
    values = [float(v) for v in rng.sample(range(10_000_000), 50_000)]
    ranks = {v: i + 1 for i, v in enumerate(sorted(values))}
    for accuracy in (100, 1_000):
        row = stats_approx(frame(spark, {True: values}).repartition(8), accuracy=accuracy).first()
        for name, p in QUARTILES.items():
            assert abs(ranks[row[name]] - p * len(values)) <= len(values) / accuracy + 1
        assert row["min"] <= row["25th_percentile"] <= row["50th_percentile"] <= row["75th_percentile"] <= row["max"]
