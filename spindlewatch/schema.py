"""Column contracts: the cleaned telemetry table, the report results and the timing log."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw columns the cleaning job needs and the identifier patterns.
RAW_COLUMNS = ("date", "serial_number", "model", "failure", "vault_id", "s9_power_on_hours")
SERIAL_PATTERN = r"^[A-Z0-9_-]+$"
MODEL_PATTERN = r"^[A-Z0-9 ]+$"

FORMATS = ("parquet", "avro")

TELEMETRY = T.StructType([
    T.StructField("event_date", T.DateType()),
    T.StructField("serial_number", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("failure", T.BooleanType()),
    T.StructField("vault_id", T.IntegerType()),
    T.StructField("s9_power_on_hours", T.DoubleType()),
])

TIMING_LOG = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("worker_nodes", T.IntegerType()),
    T.StructField("execution_time", T.DoubleType()),
])


@dataclass(frozen=True)
class Report:
    """Name, schema and row order of one result; ``descending`` lists the columns sorted downwards.

    A result that grows with the table is exported as one value for each combination of ``split_by``.
    """

    name: str
    schema: T.StructType
    sort: tuple[str, ...]
    descending: tuple[str, ...] = ()
    split_by: tuple[str, ...] = ()

    def order(self) -> list[Column]:
        return [F.desc(c) if c in self.descending else F.asc(c) for c in self.sort]

    def sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*self.order())

    def renamed(self, name: str) -> Report:
        return replace(self, name=name)


# Report names, headers and sort orders.
VAULT_DAYS = Report(
    "query1",
    T.StructType([
        T.StructField("event_date", T.DateType()),
        T.StructField("vault_id", T.IntegerType()),
        T.StructField("failures_count", T.LongType()),
    ]),
    sort=("event_date", "vault_id", "failures_count"),
    split_by=("event_date",),
)
TOP_MODELS = Report(
    "query2-1",
    T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("failures_count", T.LongType()),
    ]),
    sort=("failures_count", "model"),
    descending=("failures_count",),
)
TOP_VAULTS = Report(
    "query2-2",
    T.StructType([
        T.StructField("vault_id", T.IntegerType()),
        T.StructField("failures_count", T.LongType()),
        T.StructField("list_of_models", T.StringType()),
    ]),
    sort=("failures_count", "vault_id"),
    descending=("failures_count",),
)
HOURS_STATS = Report(
    "query3",
    T.StructType([
        T.StructField("failure", T.IntegerType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("25th_percentile", T.DoubleType()),
        T.StructField("50th_percentile", T.DoubleType()),
        T.StructField("75th_percentile", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("count", T.LongType()),
    ]),
    sort=("failure",),
)
AVERAGES = Report("average_evaluation", TIMING_LOG, sort=("query", "format", "worker_nodes"))
REPORTS = {r.name: r for r in (VAULT_DAYS, TOP_MODELS, TOP_VAULTS, HOURS_STATS)}

# Percentile column names and their probabilities.
QUARTILES = {"25th_percentile": 0.25, "50th_percentile": 0.5, "75th_percentile": 0.75}
