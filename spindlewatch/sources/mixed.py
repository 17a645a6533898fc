"""Raw telemetry whose files do not agree on the types of their columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.files import opened
from spindlewatch.schema import RAW_COLUMNS


def _footer(path: str) -> str:
    """The names and types of a parquet file's columns, in order of name."""
    files, inner = opened(path)
    with files.open_input_file(inner) as file:
        fields = pq.read_schema(file).remove_metadata()
    return ", ".join(sorted(f"{field.name} {field.type}" for field in fields))


def schemas(spark: SparkSession, path: str) -> DataFrame:
    """(path, columns) of every parquet file below ``path``. Tasks read the footers; the files' content stays unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_footer(name) for name in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "columns"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "path string, columns string")


def read_raw_groups(spark: SparkSession, path: str) -> list[DataFrame]:
    """The raw telemetry below ``path``, one frame for the files of each schema, in order of the schemas.

    A scan has one schema, and a file whose column has another type fails it. Files that agree in the names and types of
    all columns share a scan here; partition columns in the folders' names are kept. The driver gets the names of the files,
    which it holds for any scan. A folder without files, or files without one of the raw columns, are errors.
    """
    groups = schemas(spark, path).groupBy("columns").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("columns").collect()
    if not groups:
        raise ValueError(f"{path} has no files")
    frames = []
    for group in groups:
        # A single file or a pattern is no folder whose partitions could have names.
        folder = not any(c in path for c in "*?[{") and not group.paths[0].endswith(path.rstrip("/"))
        reader = spark.read.option("basePath", path) if folder else spark.read
        df = reader.parquet(*group.paths)
        missing = [c for c in RAW_COLUMNS if c not in df.columns]
        if missing:
            raise ValueError(f"{group.paths[0]} lacks the columns {', '.join(missing)}")
        frames.append(df)
    return frames
