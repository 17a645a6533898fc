"""Files of any format that tasks write to and read from the shared folder, by the file systems of Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. ``file:/x`` is ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = locate(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def new_file(folder: str, suffix: str) -> Iterator[tuple[str, object]]:
    """A file in ``folder`` that no other attempt writes, as (uri, stream). It goes if the block fails.

    Tasks may run twice: only the files that a task's output rows name belong to the result.
    """
    name = f"{uuid.uuid4().hex}{suffix}"
    system, path = locate(folder)
    path = f"{path.rstrip('/')}/{name}"
    stream = system.open_output_stream(path, compression=None)
    try:
        yield f"{folder.rstrip('/')}/{name}", stream
    except BaseException:
        stream.close()
        system.delete_file(path)
        raise
    stream.close()


def read_range(uri: str, start: int, size: int) -> bytes:
    """Up to ``size`` bytes from ``start``."""
    system, path = locate(uri)
    with system.open_input_file(path) as file:
        size = min(size, file.size() - start)
        return file.read_at(size, start) if size > 0 else b""
