import json

import pytest

from spindlewatch.plans import reports
from spindlewatch.plans.timing import mean_times, measure, total_times
from spindlewatch.schema import HOURS_STATS, TELEMETRY, TOP_MODELS, TOP_VAULTS, VAULT_DAYS
from spindlewatch.sinks.key_value import export, to_key_value
from spindlewatch.sinks.tables import BY_DISK, write_result, write_telemetry
from spindlewatch.sinks.timing_log import append_timings, timing_frame
from spindlewatch.sources.tables import read_raw, read_result, read_telemetry, read_timing_log
from tests.helpers import day, failures, telemetry

ROWS = [(1, "SN-1", "A", True, 1, 1.5), (2, "SN-2", "B 2", False, 2, 2.0), (2, "SN-1", "A", True, 1, 3.0)]


@pytest.mark.parametrize("layout", [
    {}, {"partition_by": ()}, {"partition_by": ("event_date",)}, {"cluster_by": BY_DISK},
    {"partition_by": ("event_date", "failure"), "cluster_by": "event_date"},
])
def test_telemetry_round_trip(spark, tmp_path, layout):
    df = telemetry(spark, ROWS)
    for _ in range(2):
        write_telemetry(df, f"{tmp_path}/t", **layout)
    back = read_telemetry(spark, f"{tmp_path}/t")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in TELEMETRY]
    assert sorted(back.collect()) == sorted(df.collect())


def test_avro_round_trip(spark, tmp_path):
    df = telemetry(spark, ROWS)
    try:
        write_telemetry(df, f"{tmp_path}/t", "avro")
    except Exception as missing:
        if "avro" in str(missing).lower():
            pytest.skip("the session has no avro package")
        raise
    assert sorted(read_telemetry(spark, f"{tmp_path}/t", "avro").collect()) == sorted(df.collect())


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        read_raw(spark, str(tmp_path), "orc")
    with pytest.raises(ValueError):
        write_telemetry(telemetry(spark, ROWS), f"{tmp_path}/t", "csv")


def test_raw_table_must_have_the_columns(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/raw")
    with pytest.raises(ValueError, match="serial_number"):
        read_raw(spark, f"{tmp_path}/raw")


def test_csv_round_trip_with_commas(spark, tmp_path):
    df = failures(spark, {(1, "A", 1): 2, (1, "B", 1): 1, (1, "C", 2): 1})
    write_result(reports.top_vaults(df), f"file://{tmp_path}", TOP_VAULTS)
    assert read_result(spark, str(tmp_path), TOP_VAULTS).collect() == [(1, 3, "A,B"), (2, 1, "C")]


def test_csv_of_every_report(spark, tmp_path):
    df = failures(spark, {(1, "A", 1): 2, (2, "B", 1): 1, (1, "C", 2): 3})
    for report, frame in (
        (VAULT_DAYS, reports.vault_days(df)), (TOP_MODELS, reports.top_models(df)),
        (HOURS_STATS, reports.hours_stats(df)),
    ):
        path = write_result(frame, str(tmp_path), report)
        back = read_result(spark, str(tmp_path), report)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in frame.schema]
        assert back.collect() == report.sorted(frame).collect() != []
        assert path == f"{tmp_path}/{report.name}.csv"


def test_csv_of_an_empty_result(spark, tmp_path):
    write_result(reports.vault_days(telemetry(spark, [])), str(tmp_path), VAULT_DAYS)
    assert read_result(spark, str(tmp_path), VAULT_DAYS).collect() == []


def test_large_result_keeps_its_order_across_part_files(spark, tmp_path):
    df = spark.range(200_000).selectExpr(
        "date_add(date'2024-01-01', CAST(id % 500 AS INT)) AS event_date", "CAST(id DIV 500 AS INT) AS vault_id",
        "2L AS failures_count",
    )
    small_parts = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in small_parts.items():
        spark.conf.set(key, value)
    try:
        path = write_result(df, str(tmp_path), VAULT_DAYS)
    finally:
        for key in small_parts:
            spark.conf.unset(key)
    lines = [
        line for part in sorted((tmp_path / "query1.csv").glob("part-*")) for line in part.read_text().splitlines()[1:]
    ]
    assert len(list((tmp_path / "query1.csv").glob("part-*"))) > 1
    assert path.endswith("query1.csv")
    keys = [(d, int(v)) for d, v, _ in (line.split(",") for line in lines)]
    assert len(keys) == 200_000 and keys == sorted(keys)


def test_json_has_types_nulls_and_order(spark):
    df = spark.createDataFrame([(1, 5, 'a,"b"'), (3, 9, None), (2, 9, "c")], TOP_VAULTS.schema)
    key, value = to_key_value(df, TOP_VAULTS).first()
    assert key == "query2-2"
    assert json.loads(value) == [
        {"vault_id": 2, "failures_count": 9, "list_of_models": "c"},
        {"vault_id": 3, "failures_count": 9, "list_of_models": None},
        {"vault_id": 1, "failures_count": 5, "list_of_models": 'a,"b"'},
    ]


def test_json_split_by_day(spark):
    df = spark.createDataFrame([(day(2), 1, 2), (day(1), 2, 3), (day(1), 1, 4)], VAULT_DAYS.schema)
    pairs = {k: json.loads(v) for k, v in to_key_value(df, VAULT_DAYS).collect()}
    assert pairs == {
        "query1/2024-01-01": [
            {"event_date": "2024-01-01", "vault_id": 1, "failures_count": 4},
            {"event_date": "2024-01-01", "vault_id": 2, "failures_count": 3},
        ],
        "query1/2024-01-02": [{"event_date": "2024-01-02", "vault_id": 1, "failures_count": 2}],
    }


def test_export_hands_every_pair_over(spark, tmp_path):
    df = spark.createDataFrame([("A", 2), ("B", 1)], TOP_MODELS.schema)
    folder = str(tmp_path)

    def put(rows):
        for row in rows:
            with open(f"{folder}/{row.key}", "w") as out:
                out.write(row.value)

    export(to_key_value(df, TOP_MODELS), put)
    assert json.loads((tmp_path / "query2-1").read_text())[0] == {"model": "A", "failures_count": 2}


def test_timing_log(spark, tmp_path):
    path = f"{tmp_path}/evaluation.csv"
    runs = [(q, f, 2, s) for q in ("query1", "query2") for f in ("parquet", "avro") for s in (1.0, 2.0)]
    append_timings(timing_frame(spark, runs), path)
    append_timings(timing_frame(spark, [("query1", "avro", 3, 5.0)]), path)
    log = read_timing_log(spark, path)
    assert sorted(log.collect()) == sorted([*runs, ("query1", "avro", 3, 5.0)])
    assert sorted(mean_times(log).collect()) == [
        ("query1", "avro", 2, 1.5), ("query1", "avro", 3, 5.0), ("query1", "parquet", 2, 1.5),
        ("query2", "avro", 2, 1.5), ("query2", "parquet", 2, 1.5),
    ]
    assert sorted(total_times(log).collect()) == [("query1", 11.0), ("query2", 6.0)]


def test_measure(spark):
    log = measure(spark, {"a": lambda: spark.range(10), "b": lambda: spark.range(5)}, "avro", 4, runs=3)
    rows = log.collect()
    assert [(r.query, r.format, r.worker_nodes) for r in rows] == [("a", "avro", 4)] * 3 + [("b", "avro", 4)] * 3
    assert all(r.execution_time > 0 for r in rows)


def test_an_overwrite_replaces_everything_whatever_the_session_says(spark, tmp_path):
    path = f"{tmp_path}/table"
    write_telemetry(telemetry(spark, [(1, "SN-1", "M", True, 1, 1.0), (1, "SN-2", "M", False, 1, 1.0)]), path)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_telemetry(telemetry(spark, [(2, "SN-3", "M", False, 1, 1.0)]), path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [r.serial_number for r in read_telemetry(spark, path).collect()] == ["SN-3"]


def test_a_result_of_many_parts_is_read_in_order(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "date_add(DATE'2024-01-01', CAST(id % 300 AS INT)) AS event_date", "CAST(id AS INT) AS vault_id", "2L AS failures_count"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_result(rows, str(tmp_path), VAULT_DAYS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = [(r.event_date, r.vault_id) for r in read_result(spark, str(tmp_path), VAULT_DAYS).collect()]
    assert len(read) == 20_000 and read == sorted(read)
