from datetime import date

import pytest

from spindlewatch.operators import cleaning
from spindlewatch.schema import RAW_COLUMNS, TELEMETRY

GOOD = ("2024-01-05", "SN-1", "MDL 1", "0", "7", "12.5")
SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def changed(**values):
    row = dict(zip(RAW_COLUMNS, GOOD)) | values
    return tuple(row[c] for c in RAW_COLUMNS)


def test_types_and_names(spark):
    out = cleaning.clean(raw(spark, GOOD, changed(failure="1")))
    assert out.schema.names == TELEMETRY.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in TELEMETRY]
    assert sorted(out.collect(), key=lambda r: r.failure) == [
        (date(2024, 1, 5), "SN-1", "MDL 1", False, 7, 12.5),
        (date(2024, 1, 5), "SN-1", "MDL 1", True, 7, 12.5),
    ]


def test_a_null_in_any_column_drops_the_row(spark):
    rows = [changed(**{c: None}) for c in RAW_COLUMNS]
    assert cleaning.drop_nulls(raw(spark, GOOD, *rows)).count() == 1


def test_a_null_in_a_further_column_drops_the_row(spark):
    df = spark.createDataFrame([(*GOOD, "x"), (*changed(serial_number="SN-2"), None)], SCHEMA + ", other string")
    assert [r.serial_number for r in cleaning.clean(df).collect()] == ["SN-1"]


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(*GOOD, "a"), (*GOOD, "a"), (*GOOD, "b"), (*changed(vault_id="07"), "a")], SCHEMA + ", other string"
    )
    assert cleaning.clean(df).count() == 1
    assert cleaning.clean(df, dedup="raw").count() == 3
    assert cleaning.clean(df, dedup=None).count() == 4
    with pytest.raises(ValueError):
        cleaning.clean(df, dedup="some")


@pytest.mark.parametrize("dedup", ["projected", "raw"])
def test_values_that_do_not_parse_are_dropped(spark, dedup):
    bad = [
        changed(vault_id="12x"),
        changed(failure="1.0"),
        changed(date="2023-04-31"),
        changed(s9_power_on_hours="n/a"),
    ]
    out = cleaning.clean(raw(spark, changed(vault_id=" 7 "), *bad), dedup=dedup).collect()
    assert [(r.vault_id, r.s9_power_on_hours) for r in out] == [(7, 12.5)]


def test_cast_project_keeps_rows_that_do_not_parse_as_null(spark):
    row = cleaning.cast_project(raw(spark, changed(vault_id="12x", date="2024-01-05 13:00:00"))).first()
    assert row.vault_id is None
    assert row.event_date == date(2024, 1, 5)


def test_typed_raw_columns(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-05 10:11:12' AS date, 'SN-1' AS serial_number, 'MDL 1' AS model, 1 AS failure, "
        "7L AS vault_id, 12 AS s9_power_on_hours"
    )
    assert cleaning.clean(df).collect() == [(date(2024, 1, 5), "SN-1", "MDL 1", True, 7, 12.0)]


def test_nan_hours_count_as_missing(spark):
    df = spark.sql(
        "SELECT '2024-01-05' AS date, 'SN-1' AS serial_number, 'MDL 1' AS model, '1' AS failure, '7' AS vault_id, h "
        "AS s9_power_on_hours FROM VALUES (double('NaN')), (2D) AS t(h)"
    )
    assert [r.s9_power_on_hours for r in cleaning.clean(df).collect()] == [2.0]


def test_serial_numbers(spark):
    serials = ["SN-1", "A_B", "sn-1", "SN#1", "", "SN 1", "SN\n"]
    df = raw(spark, *[changed(serial_number=s) for s in serials])
    assert [r.serial_number for r in cleaning.filter_serial(df).collect()] == ["SN-1", "A_B", "SN\n"]
    assert [r.serial_number for r in cleaning.filter_serial(df, strict=True).collect()] == ["SN-1", "A_B"]


def test_models(spark):
    models = ["MDL 1", "MDL-1", "MDL_1", "mdl 1", "", "M.1", "MDL\n"]
    df = raw(spark, *[changed(model=m) for m in models])
    assert [r.model for r in cleaning.filter_model(df).collect()] == ["MDL 1", "MDL\n"]
    assert [r.model for r in cleaning.filter_model(df, strict=True).collect()] == ["MDL 1"]


def test_cleaning_twice_changes_nothing(spark):
    once = cleaning.clean(raw(spark, GOOD, GOOD, changed(model="m"), changed(serial_number="SN-2")))
    twice = cleaning.clean(once.withColumnRenamed("event_date", "date"))
    assert sorted(once.collect()) == sorted(twice.collect())


@pytest.mark.parametrize("text, vault", [
    ("1122.0", 1122), ("1122.7", 1122), (" 7 ", 7), ("-3.9", -3), ("8.", 8), ("12x", None), ("1.2.3", None), ("1e3", None), ("x.0", None),
    ("99999999999", None), ("99999999999.0", None), ("", None),
])
def test_whole_numbers_written_with_a_fraction(spark, text, vault):
    assert cleaning.cast_project(raw(spark, changed(vault_id=text))).first().vault_id == vault
    kept = cleaning.clean(raw(spark, changed(vault_id=text))).count()
    assert kept == cleaning.clean(raw(spark, changed(vault_id=text)), dedup="raw").count() == (vault is not None)


def test_columns_that_are_typed_already(spark):
    df = raw(spark, GOOD).selectExpr(*RAW_COLUMNS[:4], "1122.7D AS vault_id", "12.5D AS s9_power_on_hours")
    assert cleaning.clean(df).first().vault_id == 1122
