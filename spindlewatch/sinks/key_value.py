"""Report results as key/value pairs with JSON values."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spindlewatch.schema import Report

JSON_OPTIONS = {"ignoreNullFields": "false"}


def _compare(report: Report) -> Callable[[Column, Column], Column]:
    def compare(a: Column, b: Column) -> Column:
        result = F.lit(0)
        for name in reversed(report.sort):
            x, y = (b[name], a[name]) if name in report.descending else (a[name], b[name])
            result = F.when(x < y, -1).when(x > y, 1).otherwise(result)
        return result

    return compare


def to_key_value(df: DataFrame, report: Report) -> DataFrame:
    """One ``(key, value)`` row per array of result rows: a JSON array of typed objects, in the report's order.

    The results of known small size, the top-k lists and the two rows of hour statistics, become one value under the
    report's name. The vault-day list grows with the table and is split as its report says: one array per day, under
    ``name/day``, never longer than the number of vaults.
    """
    key = F.concat_ws("/", F.lit(report.name), *[F.col(c).cast("string") for c in report.split_by])
    rows = F.array_sort(F.collect_list(F.struct(*report.schema.names)), _compare(report))
    return (
        df.groupBy(key.alias("key")).agg(F.to_json(rows, JSON_OPTIONS).alias("value"))
    )


def export(pairs: DataFrame, put_partition: Callable[[Iterable[Row]], None]) -> None:
    """Hand the pairs to a store: ``put_partition`` runs on the executors, once per partition.

    A task that is lost is run again, so ``put_partition`` must be a plain overwrite of its keys.
    """
    pairs.foreachPartition(put_partition)
