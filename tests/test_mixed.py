"""Raw files whose types differ."""

from datetime import date

import pytest

from spindlewatch.operators.cleaning import clean, clean_groups
from spindlewatch.plans import job
from spindlewatch.sources.mixed import read_raw_groups, schemas

ROWS = [
    ("2024-01-01", "SN-1", "A", "0", "1122.0", "1.5"), ("2024-01-02", "SN-1", "A", "1", "1122", "2"),
    ("2024-01-02", "SN-2", "B 2", "0", "7", "3.25"), ("2024-01-03", "bad id", "B 2", "0", "7", "4"),
    ("2024-01-03", "SN-3", "A", "0", None, "4"), ("2024-01-04", "SN-3", "A", "true", "8", "x"),
]
NAMES = ["date", "serial_number", "model", "failure", "vault_id", "s9_power_on_hours"]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{name} string" for name in NAMES))


def typed(raw):
    return raw.selectExpr(
        "CAST(date AS date) AS date", "serial_number", "model", "failure = '1' AS failure",
        "CAST(TRY_CAST(vault_id AS double) AS int) AS vault_id", "TRY_CAST(s9_power_on_hours AS double) AS s9_power_on_hours",
    )


def test_files_of_three_types_are_cleaned_as_one_table(spark, tmp_path, raw):
    path = f"{tmp_path}/raw"
    raw.coalesce(1).write.parquet(path)
    typed(raw.limit(3)).coalesce(1).write.mode("append").parquet(path)
    raw.selectExpr("s9_power_on_hours", "vault_id", "1 AS smart_1", "date", "serial_number", "model", "failure").where(
        "serial_number = 'SN-2'"
    ).coalesce(1).write.mode("append").parquet(path)
    groups = read_raw_groups(spark, path)
    assert len(groups) == 3 and schemas(spark, path).count() == 3
    expected = clean(raw).collect()
    # Copies of one row in files of different types are one row.
    assert sorted(clean_groups(groups).collect()) == sorted(expected) and len(expected) == 3
    assert clean_groups(groups, None).count() == 3 + 3 + 1
    written = job.prepare(spark, path, f"{tmp_path}/clean", mixed=True)
    assert sorted(written.collect()) == sorted(expected)


def test_files_of_one_type_are_one_scan(spark, tmp_path, raw):
    path = f"{tmp_path}/raw"
    raw.repartition(4).write.parquet(path)
    # The order of columns is no difference.
    raw.select(*reversed(NAMES)).where("vault_id = '7'").coalesce(1).write.mode("append").parquet(path)
    (group,) = read_raw_groups(spark, path)
    assert group.count() == len(ROWS) + 2


def test_partition_columns_in_names_of_folders(spark, tmp_path, raw):
    path = f"{tmp_path}/raw"
    raw.where("vault_id IS NOT NULL").write.partitionBy("date").parquet(path)
    groups = read_raw_groups(spark, path)
    assert sorted(clean_groups(groups).collect()) == sorted(clean(raw).collect())
    assert {r.date for g in groups for r in g.select("date").distinct().collect()} == {date(2024, 1, n) for n in (1, 2, 3, 4)}


def test_a_single_file_and_a_pattern(spark, tmp_path, raw):
    path = f"{tmp_path}/raw"
    raw.coalesce(1).write.parquet(path)
    (file,) = (tmp_path / "raw").glob("*.parquet")
    for name in (str(file), f"{path}/*.parquet", f"{tmp_path}/r*"):
        assert sum(g.count() for g in read_raw_groups(spark, name)) == len(ROWS)


def test_what_is_refused(spark, tmp_path, raw):
    raw.drop("model").write.parquet(f"{tmp_path}/lacking")
    with pytest.raises(ValueError, match="model"):
        read_raw_groups(spark, f"{tmp_path}/lacking")
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no files"):
        read_raw_groups(spark, f"{tmp_path}/empty")
    with pytest.raises(ValueError, match="raw"):
        clean_groups([raw], "raw")
    with pytest.raises(ValueError, match="parquet"):
        job.prepare(spark, "x", "y", "avro", mixed=True)


def test_duplicates_are_removed_in_one_shuffle(spark, tmp_path, raw):
    path = f"{tmp_path}/raw"
    raw.write.parquet(path)
    typed(raw).write.mode("append").parquet(path)
    plan = clean_groups(read_raw_groups(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan parquet") == 2
