"""Key/value export that shows either all of a run's pairs or none: tasks stage them, the driver's commit publishes.

``put_partition`` of :mod:`spindlewatch.sinks.key_value` writes as its task runs, so a job that fails leaves the pairs of
the tasks that had ended. Here Spark's own commit protocol for writers decides: what a lost, repeated or speculative task
staged is published for one attempt of it, and nothing is if the job fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from spindlewatch.files import opened


class Store(Protocol):
    """What an export needs of a store. It is sent to the tasks."""

    def stage(self, run: str, attempt: str, pairs: Iterable[tuple[str, str]]) -> None:
        """Keep the pairs where no reader sees them. Runs in the tasks."""

    def publish(self, run: str, attempts: list[str]) -> None:
        """Show the pairs of these attempts, each in the place of an older one with its key, and forget the run's others."""

    def discard(self, run: str) -> None:
        """Forget all that the run has staged."""

    def published(self, run: str) -> bool:
        """Whether the run has been published before."""


@dataclass(frozen=True)
class FolderStore:
    """A store in a folder that tasks and driver reach: one JSON file for each key, named by the key's hash.

    Its file system must let a move replace a file.

    Publishing first notes the attempts, then moves their files one by one, each move replacing one key's pair as a whole.
    A driver that is lost between leaves the note, with which :meth:`recover` or the next run of that name goes on.
    """

    path: str

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        files, root = opened(self.path)
        return files, "/".join((root.rstrip("/"), *parts))

    def _exists(self, *parts: str) -> bool:
        files, path = self._at(*parts)
        return files.get_file_info(path).type != fs.FileType.NotFound

    def _names(self, *parts: str) -> list[str]:
        files, path = self._at(*parts)
        return sorted(info.base_name for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)))

    def _put(self, text: str, *parts: str) -> None:
        files, path = self._at(*parts)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}.part") as out:
            out.write(text.encode())
        files.move(f"{path}.part", path)

    def stage(self, run: str, attempt: str, pairs: Iterable[tuple[str, str]]) -> None:
        for key, value in pairs:
            name = f"{hashlib.sha256(key.encode()).hexdigest()}.json"
            self._put(json.dumps({"key": key, "value": value}), "staged", run, attempt, name)

    def publish(self, run: str, attempts: list[str]) -> None:
        self._put(json.dumps(attempts), "staged", run, "publish")
        self._finish(run)

    def _finish(self, run: str) -> None:
        files, note = self._at("staged", run, "publish")
        with files.open_input_stream(note) as file:
            attempts = json.loads(file.read())
        files.create_dir(self._at("pairs")[1], recursive=True)
        for attempt in attempts:
            for name in self._names("staged", run, attempt):
                files.move(self._at("staged", run, attempt, name)[1], self._at("pairs", name)[1])
        self._put("", "runs", run)
        self.discard(run)

    def discard(self, run: str) -> None:
        if self._exists("staged", run):
            files, path = self._at("staged", run)
            files.delete_dir(path)

    def published(self, run: str) -> bool:
        if self._exists("staged", run, "publish"):
            self._finish(run)
        return self._exists("runs", run)

    def recover(self) -> None:
        """Publish to the end the runs whose driver was lost while it published."""
        for run in self._names("staged"):
            self.published(run)

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, value) of all published pairs."""
        return spark.read.schema("key string, value string").json(f"{self.path.rstrip('/')}/pairs")


@dataclass
class _Staged(WriterCommitMessage):
    attempt: str


class _Writer(DataSourceWriter):
    def __init__(self, store: Store, run: str):
        self.store, self.run = store, run

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        attempt = uuid.uuid4().hex
        self.store.stage(self.run, attempt, ((row.key, row.value) for row in iterator))
        return _Staged(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.store.publish(self.run, [m.attempt for m in messages if m is not None])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.store.discard(self.run)


def export_committed(pairs: DataFrame, store: Store, run: str | None = None) -> bool:
    """Put the ``(key, value)`` rows into ``store``, all or none, and say whether that was done now.

    Keys must be distinct, as :func:`spindlewatch.sinks.key_value.to_key_value` makes them. A run with a name is done once:
    a repeated one writes nothing. Pairs of other keys stay. A value and the pairs of one task are in no place but that task.
    """
    name = run or uuid.uuid4().hex
    if store.published(name):
        return False
    # What a run of this name left that was lost before its commit.
    store.discard(name)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "spindlewatch_key_value"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(store, name)

    spark = pairs.sparkSession
    spark.dataSource.register(Source)
    pairs.select("key", "value").write.format(Source.name()).mode("append").save()
    return True
