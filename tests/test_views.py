import random
import re

import pytest
from pyspark.sql import functions as F

from spindlewatch.operators.cleaning import clean
from spindlewatch.operators.disks import disk_collapse
from spindlewatch.operators.failures import failures_by_day_vault_model
from spindlewatch.plans.reports import hours_stats, vault_days
from spindlewatch.schema import RAW_COLUMNS, TELEMETRY
from spindlewatch.sinks.tables import write_telemetry
from spindlewatch.sources.tables import read_telemetry
from spindlewatch.streaming import views
from spindlewatch.streaming.ingest import LAYOUT, append_new
from spindlewatch.streaming.views import DiskState, FailureCounts, VaultDayChanges

SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)


def batches(seed, count=3):
    """Raw batches in disorder, with rows that stand in several of them, counters that restart and bad rows."""
    rng = random.Random(seed)
    rows = [
        (f"2024-01-{rng.randrange(1, 10):02}", f"SN-{rng.randrange(25)}", f"MDL {rng.randrange(3)}", str(int(rng.random() < 0.4)),
         str(rng.randrange(4)), str(rng.randrange(0, 200)))
        for _ in range(240)
    ]
    rows += [(None, "SN-1", "MDL 1", "1", "1", "5"), ("2024-01-02", "bad", "MDL 1", "1", "1", "999")]
    out = [[r for r in rows if rng.random() < 0.35] for _ in range(count)]
    return [*out, out[1], [rows[-1]], out[0]]


def table_at(spark, path):
    write_telemetry(spark.createDataFrame([], TELEMETRY), path, **LAYOUT, mode="append")
    return path


def checked(spark, seen, state, counts, changes):
    whole = clean(spark.createDataFrame([r for b in seen for r in b], SCHEMA))
    for hours in ("max", "latest"):
        assert sorted(state.disks(spark, hours).collect()) == sorted(disk_collapse(whole, hours).collect())
    assert sorted(counts.read(spark).collect()) == sorted(failures_by_day_vault_model(whole).collect())
    assert changes.read(spark).collect() == vault_days(whole).collect()


def test_views_equal_the_whole_table_after_every_batch(spark, tmp_path):
    table = table_at(spark, f"{tmp_path}/table")
    kept = DiskState(f"{tmp_path}/disks", buckets=4), FailureCounts(f"{tmp_path}/counts"), VaultDayChanges(f"{tmp_path}/changes")
    seen = []
    for batch in batches(1):
        seen.append(batch)
        append_new(spark.createDataFrame(batch, SCHEMA), table, views=kept)
        checked(spark, seen, *kept)
    changes = kept[2].changes(spark)
    assert changes.where("weight < 0").count() > 0
    # Every vault-day goes in and out at most once for each count.
    assert changes.groupBy("event_date", "vault_id", "failures_count").agg(F.count("*").alias("n")).where("n > 2").count() == 0


def test_a_batch_that_breaks_off_anywhere_is_made_good_when_it_runs_again(spark, tmp_path, monkeypatch):
    table = table_at(spark, f"{tmp_path}/table")
    kept = DiskState(f"{tmp_path}/disks", buckets=4), FailureCounts(f"{tmp_path}/counts"), VaultDayChanges(f"{tmp_path}/changes")
    first, second, *_ = batches(3)
    append_new(spark.createDataFrame(first, SCHEMA), table, views=kept)
    replace = views._replace

    for left in range(1, 5):
        done = []

        def breaking(df, path, partition):
            if len(done) == left - 1:
                # Some partitions of the batch are written, others are not.
                rows = df.select(partition).distinct().collect()
                replace(df.where(F.col(partition).isin([r[0] for r in rows[: len(rows) // 2]])), path, partition)
                raise OSError("lost")
            done.append(path)
            replace(df, path, partition)

        monkeypatch.setattr(views, "_replace", breaking)
        with pytest.raises(OSError, match="lost"):
            append_new(spark.createDataFrame(second, SCHEMA), table, views=kept)
        monkeypatch.setattr(views, "_replace", replace)
        if left < 3:
            # Until the heads are written, the disks are those before the batch.
            before = disk_collapse(clean(spark.createDataFrame(first, SCHEMA)))
            assert sorted(kept[0].disks(spark).collect()) == sorted(before.collect())
    append_new(spark.createDataFrame(second, SCHEMA), table, views=kept)
    checked(spark, [first, second], *kept)


def test_a_batch_reads_the_buckets_of_its_disks_and_the_days_of_its_rows_alone(spark, tmp_path):
    table = table_at(spark, f"{tmp_path}/table")
    state, counts = DiskState(f"{tmp_path}/disks", buckets=16), FailureCounts(f"{tmp_path}/counts")
    everything = [(f"2024-01-{d:02}", f"SN-{i}", "MDL 1", "1", "7", "5") for d in range(1, 11) for i in range(60)]
    append_new(spark.createDataFrame(everything, SCHEMA), table, views=[state, counts])
    version, held = state.heads(spark)
    assert version == 1 and len(held) == 16
    batch = clean(spark.createDataFrame([("2024-01-03", "SN-4", "MDL 2", "1", "7", "9")], SCHEMA))
    touched = batch.select(state._bucket()).first()[0]
    old = [slot for slot in held if slot // 2 == touched]
    merged = state.merged(batch, old)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*slot#\d+ = {old[0]}\)", plan)
    assert {r.slot for r in state.state(spark, old).collect()} == set(old)
    days = [r.event_date for r in batch.collect()]
    plan = counts.counted(read_telemetry(spark, table), days)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_date#\d+ = 2024-01-03", plan) and re.search(r"PartitionFilters: \[[^\]]*failure", plan)
    # The next batch writes the other slot of that bucket, all other heads stay.
    append_new(spark.createDataFrame([("2024-01-03", "SN-4", "MDL 2", "1", "7", "9")], SCHEMA), table, views=[state, counts])
    assert set(held) ^ set(state.heads(spark)[1]) == {2 * touched, 2 * touched + 1}


def test_sketches_answer_the_report(spark, tmp_path):
    table = table_at(spark, f"{tmp_path}/table")
    state = DiskState(f"{tmp_path}/disks", buckets=8)
    rows = [(f"2024-01-{1 + i % 3:02}", f"SN-{i % 4000}", "MDL 1", str(int(i % 4000 < 900)), "7", str(i * 37 % 10007)) for i in range(8000)]
    for part in (rows[5000:], rows[:5000], rows[2000:6000]):
        append_new(spark.createDataFrame(part, SCHEMA), table, views=[state])
    exact = {r.failure: r for r in hours_stats(clean(spark.createDataFrame(rows, SCHEMA))).collect()}
    found = state.hours_stats(spark)
    assert "disks" not in re.findall(r"Location:.*?\]", found._jdf.queryExecution().executedPlan().toString())
    found = {r.failure: r for r in found.collect()}
    values = {f: sorted(h.s9_power_on_hours for h in state.disks(spark).where(f"failure = {bool(f)}").collect()) for f in (0, 1)}
    for flag, row in exact.items():
        assert (found[flag]["min"], found[flag]["max"], found[flag]["count"]) == (row["min"], row["max"], row["count"])
        for name, p in (("25th_percentile", 0.25), ("50th_percentile", 0.5), ("75th_percentile", 0.75)):
            rank = sum(v <= found[flag][name] for v in values[flag]) / len(values[flag])
            assert abs(rank - p) <= 0.01


def test_empty_batches_and_states(spark, tmp_path):
    table = table_at(spark, f"{tmp_path}/table")
    kept = DiskState(f"{tmp_path}/disks", buckets=4), FailureCounts(f"{tmp_path}/counts"), VaultDayChanges(f"{tmp_path}/changes")
    checked(spark, [[("2024-01-01", "bad", "MDL 1", "1", "1", "1")]], *kept)
    append_new(spark.createDataFrame([("2024-01-01", "bad", "MDL 1", "1", "1", "1")], SCHEMA), table, views=kept)
    checked(spark, [[("2024-01-01", "bad", "MDL 1", "1", "1", "1")]], *kept)
    assert kept[0].hours_stats(spark).collect() == []
    with pytest.raises(ValueError, match="hours"):
        kept[0].disks(spark, "mean")
