"""Columns that are computed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, keep: Sequence[str], **new: Column) -> DataFrame:
    """The columns ``keep`` and ``new``.

    The optimizer puts a projected expression in the place of its column, in filters that it moves below the projection
    and inside lambda functions, where the expression would run again for each element. The single row that is generated
    here for each row is a place beyond which it does not look.
    """
    made = F.struct(*[column.alias(name) for name, column in new.items()])
    return df.select(*keep, F.inline(F.array(made)))
