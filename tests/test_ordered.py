import os

from spindlewatch.operators.cleaning import clean
from spindlewatch.schema import RAW_COLUMNS
from spindlewatch.sources.tables import read_telemetry
from spindlewatch.streaming.ingest import raw_stream
from spindlewatch.streaming.ordered import distinct_stream, ingest_ordered, late_rows

SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)


def rows(day, serials):
    return [(f"2024-01-{day:02}", s, "MDL 1", "0", "7", str(day * 24)) for s in serials]


def put(spark, directory, number, content):
    target = f"{directory}/{number}"
    spark.createDataFrame(content, SCHEMA).coalesce(1).write.parquet(target)
    os.makedirs(f"{directory}/in", exist_ok=True)
    for part in os.listdir(target):
        if part.endswith(".parquet"):
            os.rename(f"{target}/{part}", f"{directory}/in/{number}.parquet")
            os.utime(f"{directory}/in/{number}.parquet", (1_700_000_000 + 10 * number,) * 2)


def arrive(spark, tmp_path, delay="2 days"):
    raw = raw_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger=1)
    late = ingest_ordered(raw, f"{tmp_path}/table", f"{tmp_path}/state", delay)
    return late, sorted(read_telemetry(spark, f"{tmp_path}/table").collect())


def batch(spark, files):
    return sorted(clean(spark.createDataFrame([r for f in files for r in f], SCHEMA)).collect())


def test_ordered_files_are_exact_with_copies_in_and_between_them(spark, tmp_path):
    files = [rows(1, ["SN-1", "SN-1", "SN-2", "bad"]), rows(1, ["SN-1"]) + rows(2, ["SN-1"]), rows(3, ["SN-1", "SN-1"]) + rows(2, ["SN-1"]), []]
    for number, content in enumerate(files):
        put(spark, tmp_path, number, content)
    late, found = arrive(spark, tmp_path)
    assert (late, found) == (0, batch(spark, files))
    # Another run goes on with the state of the first.
    more = rows(3, ["SN-1"]) + rows(4, ["SN-1"])
    put(spark, tmp_path, 9, more)
    assert arrive(spark, tmp_path) == (0, batch(spark, [*files, more]))


def test_the_number_of_late_rows_is_what_is_missing(spark, tmp_path):
    files = [rows(20, ["SN-1"]), rows(21, ["SN-1"]), rows(22, ["SN-1"]), rows(3, ["SN-1", "SN-2", "SN-3"]) + rows(21, ["SN-1", "SN-5"])]
    for number, content in enumerate(files):
        put(spark, tmp_path, number, content)
    late, found = arrive(spark, tmp_path)
    everything = batch(spark, files)
    assert late == 3 == len(everything) - len(found)
    assert set(found) < set(everything)
    assert [r.late_rows for r in late_rows(spark, f"{tmp_path}/state").collect()] == [3]


def test_the_state_is_bounded_by_the_delay(spark, tmp_path):
    for number in range(12):
        put(spark, tmp_path, number, rows(number + 1, [f"SN-{i}" for i in range(50)]))
    raw = raw_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, maxFilesPerTrigger=1)
    query = (
        distinct_stream(raw, "2 days").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/noop")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress]
    assert len(kept) >= 12 and max(kept) <= 5 * 50
