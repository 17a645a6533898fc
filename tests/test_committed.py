"""Export that publishes all of a run's pairs or none."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindlewatch.sinks.committed import FolderStore, export_committed


def pairs(spark, values):
    return spark.createDataFrame(list(values.items()), "key string, value string").repartition(4)


def contents(spark, store):
    return {r.key: r.value for r in store.read(spark).collect()}


def test_all_pairs_come_back_and_newer_values_replace_older(spark, tmp_path):
    store = FolderStore(f"{tmp_path}/store")
    first = {f"query1/2024-01-{i:02}": f'[{{"n":{i}}}]' for i in range(1, 20)} | {"": "", "ключ é/\n": 'quote " and \\ ' + "x" * 100_000}
    assert export_committed(pairs(spark, first), store)
    assert contents(spark, store) == first
    assert export_committed(pairs(spark, {"": "new", "other": "1"}), store)
    assert contents(spark, store) == first | {"": "new", "other": "1"}
    # One file for each key, and nothing staged is left.
    assert len(list((tmp_path / "store" / "pairs").iterdir())) == len(first) + 1
    assert list((tmp_path / "store" / "staged").iterdir()) == []


def test_a_failed_task_leaves_no_key_behind(spark, tmp_path):
    store = FolderStore(f"{tmp_path}/store")
    export_committed(pairs(spark, {"a": "old"}), store)
    broken = pairs(spark, {k: k for k in "abcdefgh"})
    broken = broken.withColumn("value", F.when(F.col("key") == "h", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        export_committed(broken, store, "day-1")
    assert contents(spark, store) == {"a": "old"} and list((tmp_path / "store" / "staged").iterdir()) == []
    # The run has not been published, so it can be done again under its name.
    assert export_committed(pairs(spark, {"b": "1"}), store, "day-1")
    assert contents(spark, store) == {"a": "old", "b": "1"}


def test_a_named_run_is_done_once(spark, tmp_path):
    store = FolderStore(f"{tmp_path}/store")
    assert export_committed(pairs(spark, {"a": "1"}), store, "day-1")
    before = {p.name: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/store/pairs").iterdir()}
    assert not export_committed(pairs(spark, {"a": "2", "b": "2"}), store, "day-1")
    assert contents(spark, store) == {"a": "1"}
    assert before == {p.name: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/store/pairs").iterdir()}


def test_attempts_that_were_not_committed_stay_unseen(spark, tmp_path):
    """What a speculative or repeated attempt of a task has staged."""
    store = FolderStore(f"{tmp_path}/store")
    store.stage("run", "one", [("a", "1"), ("b", "1")])
    store.stage("run", "two", [("a", "2")])
    store.publish("run", ["one"])
    assert contents(spark, store) == {"a": "1", "b": "1"} and not store._exists("staged", "run")


def test_a_driver_lost_while_it_publishes(spark, tmp_path, monkeypatch):
    store = FolderStore(f"{tmp_path}/store")
    store.stage("run", "one", [("a", "1"), ("b", "1"), ("c", "1")])
    store.stage("other", "one", [("z", "1")])
    with monkeypatch.context() as patch:
        patch.setattr(FolderStore, "_finish", lambda self, run: None)
        store.publish("run", ["one"])
    # One pair had been moved.
    name = store._names("staged", "run", "one")[0]
    files, source = store._at("staged", "run", "one", name)
    files.create_dir(store._at("pairs")[1])
    files.move(source, store._at("pairs", name)[1])
    store.recover()
    assert contents(spark, store) == {k: "1" for k in "abc"}
    # A run that may still be under way is left alone.
    assert store.published("run") and not store.published("other") and store._names("staged", "other") == ["one"]


def test_no_pairs(spark, tmp_path):
    store = FolderStore(f"file://{tmp_path}/store")
    assert export_committed(spark.createDataFrame([], "key string, value string"), store, "none")
    assert store.published("none") and contents(spark, store) == {}
