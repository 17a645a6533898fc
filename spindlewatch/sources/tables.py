"""Readers for raw and cleaned telemetry, written results and timing logs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from spindlewatch.schema import FORMATS, RAW_COLUMNS, TELEMETRY, TIMING_LOG, Report


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    return fmt


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw telemetry with whatever types and further columns its files have."""
    df = spark.read.format(check_format(fmt)).load(path)
    missing = [c for c in RAW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Cleaned telemetry. The declared schema saves inference and types the partition columns."""
    df = spark.read.format(check_format(fmt)).schema(TELEMETRY).load(path)
    return df.select(*TELEMETRY.names)


def bucketed_name(path: str) -> str:
    """The catalog's name of the bucketed table at ``path``."""
    return f"telemetry_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


def read_bucketed(spark: SparkSession, path: str, buckets: int, partition_by: Sequence[str] = ("failure",)) -> DataFrame:
    """A table that :func:`spindlewatch.sinks.tables.write_bucketed` wrote, with its layout known to the planner.

    Where the catalog does not have it, as in another session, it is declared over its files; ``buckets`` and
    ``partition_by`` must be those it was written with, and are checked against a catalog that has it.
    """
    name = bucketed_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in TELEMETRY)
        parted = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {parted} "
            f"CLUSTERED BY (serial_number) SORTED BY (serial_number) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )
        if partition_by:
            spark.catalog.recoverPartitions(name)
    known = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}.get("Num Buckets")
    if known != str(buckets):
        raise ValueError(f"{path} has {known} buckets, not {buckets}")
    return spark.table(name).select(*TELEMETRY.names)


def read_result(spark: SparkSession, directory: str, report: Report) -> DataFrame:
    """A written report, with its declared types and not as strings, in its order.

    The file source packs part files by size, so the order they were written in is not the order they are read in.
    """
    return report.sorted(spark.read.schema(report.schema).csv(f"{directory}/{report.name}.csv", header=True))


def read_timing_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING_LOG).csv(path, header=True)
