import os
import re

import pytest

from spindlewatch.operators.cleaning import clean
from spindlewatch.schema import RAW_COLUMNS
from spindlewatch.sinks.tables import write_telemetry
from spindlewatch.sources.tables import read_telemetry
from spindlewatch.streaming.ingest import LAYOUT, append_new, convert, ingest, new_rows, raw_stream

SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)


def rows(day, serials):
    return [(f"2024-01-{day:02}", s, "MDL 1", "0", "7", str(day * 24)) for s in serials]


FILES = [
    rows(9, ["SN-1", "SN-2", "bad"]) + rows(2, ["SN-3"]),
    rows(3, ["SN-1"]) + rows(9, ["SN-2", "SN-4"]),
    rows(1, ["SN-1", "SN-1"]) + rows(9, ["SN-1"]) + [(None, "SN-9", "MDL 1", "0", "7", "1")],
]


def put(spark, directory, number, content):
    target = f"{directory}/{number}"
    spark.createDataFrame(content, SCHEMA).coalesce(1).write.parquet(target)
    for part in os.listdir(target):
        if part.endswith(".parquet"):
            os.rename(f"{target}/{part}", f"{directory}/in/{number}.parquet")


def arrive(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    raw = raw_stream(spark, f"{tmp_path}/in", schema, maxFilesPerTrigger=1)
    ingest(raw, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    return sorted(read_telemetry(spark, f"{tmp_path}/table").collect())


def expected(spark, files):
    everything = spark.createDataFrame([r for f in files for r in f], SCHEMA)
    return sorted(clean(everything).collect())


def test_files_out_of_order_with_copies_between_them(spark, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    put(spark, tmp_path, 0, FILES[0])
    put(spark, tmp_path, 1, FILES[1])
    assert arrive(spark, tmp_path) == expected(spark, FILES[:2])
    put(spark, tmp_path, 2, FILES[2])
    assert arrive(spark, tmp_path) == expected(spark, FILES)
    assert arrive(spark, tmp_path) == expected(spark, FILES)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    put(spark, tmp_path, 0, FILES[0])
    arrive(spark, tmp_path)
    for content in (FILES[0], FILES[1], FILES[1]):
        append_new(spark.createDataFrame(content, SCHEMA), f"{tmp_path}/table")
    assert sorted(read_telemetry(spark, f"{tmp_path}/table").collect()) == expected(spark, FILES[:2])


def test_nothing_arrived(spark, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    assert arrive(spark, tmp_path) == []


def test_a_batch_without_a_valid_row(spark, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    put(spark, tmp_path, 0, rows(1, ["bad"]))
    assert arrive(spark, tmp_path) == []


def test_a_batch_reads_exactly_its_own_days_of_the_table(spark, tmp_path):
    table = f"{tmp_path}/table"
    everything = [r for day in range(1, 31) for r in rows(day, [f"SN-{i}" for i in range(5)])]
    write_telemetry(clean(spark.createDataFrame(everything, SCHEMA)), table, **LAYOUT)
    batch = spark.createDataFrame(rows(1, ["SN-3", "SN-5"]) + rows(30, ["SN-4", "SN-9"]), SCHEMA)
    new = new_rows(batch, table)
    assert sorted(r.serial_number for r in new.collect()) == ["SN-5", "SN-9"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]* IN \(2024-01-01,2024-01-30\)", plan)


def test_a_table_of_another_layout_is_refused_before_anything_is_written(spark, tmp_path):
    prepared, table = f"{tmp_path}/prepared", f"{tmp_path}/table"
    whole = clean(spark.createDataFrame(rows(1, ["SN-1"]) + rows(2, ["SN-2"]), SCHEMA))
    write_telemetry(whole, prepared)
    batch = spark.createDataFrame(rows(2, ["SN-2", "SN-3"]), SCHEMA)
    with pytest.raises(ValueError, match="convert"):
        append_new(batch, prepared)
    schema = spark.createDataFrame([], SCHEMA).schema
    os.mkdir(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="convert"):
        ingest(raw_stream(spark, f"{tmp_path}/in", schema), prepared, f"{tmp_path}/state")
    assert sorted(read_telemetry(spark, prepared).collect()) == sorted(whole.collect())

    convert(spark, prepared, table)
    append_new(batch, table)
    assert sorted(r.serial_number for r in read_telemetry(spark, table).collect()) == ["SN-1", "SN-2", "SN-3"]
