"""Files that tasks open by themselves, by the paths that Spark knows them under."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it. ``s3a`` and ``s3n`` are Spark's names for ``s3``."""
    scheme, separator, rest = path.partition(":")
    if not separator or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
