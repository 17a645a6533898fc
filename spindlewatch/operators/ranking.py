"""Top-k with a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spindlewatch.schema import Report


def top_k(df: DataFrame, report: Report, k: int = 10) -> DataFrame:
    """The first ``k`` rows in the report's order.

    The order ends in the key, so ties at the cut always fall the same way. Sort and limit together run as one
    bounded heap per task and a merge of k rows per task; nothing is sorted in full.
    """
    return report.sorted(df).limit(k)
