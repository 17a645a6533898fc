"""Raw telemetry -> cleaned telemetry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from spindlewatch.schema import MODEL_PATTERN, RAW_COLUMNS, SERIAL_PATTERN, TELEMETRY


def drop_nulls(df: DataFrame) -> DataFrame:
    """Rows with a value in every column. NaN counts as missing, as ``DataFrame.na.drop`` has it."""
    return df.na.drop("any")


def dedup_rows(df: DataFrame) -> DataFrame:
    """One copy of each row.

    The distinct is a partial aggregate on both sides of the shuffle, hashed on every column: a group of copies
    shrinks to one row per task before it moves, and distinct rows of one disk or vault spread over all tasks.
    """
    return df.dropDuplicates()


def _typed(df: DataFrame) -> dict[str, Column]:
    """The telemetry columns by name, from raw columns of any type."""
    columns = {}
    for raw, field in zip(RAW_COLUMNS, TELEMETRY.fields):
        column = F.col(raw)
        if isinstance(field.dataType, IntegerType) and isinstance(df.schema[raw].dataType, StringType):
            # A whole number written with a fraction is one to Spark outside ANSI mode, which drops the fraction.
            column = F.regexp_replace(raw, r"^(\s*[+-]?\d+)\.\d*(\s*)$", "$1$2")
        columns[field.name] = column.try_cast(field.dataType)
    return columns


def cast_project(df: DataFrame) -> DataFrame:
    """The six telemetry columns, typed. A value that does not parse becomes null instead of failing the job."""
    return df.select(*[column.alias(name) for name, column in _typed(df).items()])


def _matches(column: str, pattern: str, strict: bool) -> Column:
    # In a Java pattern, `$` also matches before a final newline; `\z` does not.
    return F.col(column).rlike(pattern[:-1] + r"\z" if strict else pattern)


def filter_serial(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.where(_matches("serial_number", SERIAL_PATTERN, strict))


def filter_model(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.where(_matches("model", MODEL_PATTERN, strict))


def clean(df: DataFrame, dedup: str | None = "projected", strict_ids: bool = False) -> DataFrame:
    """Drop incomplete rows, type the six columns, keep valid identifiers, remove duplicates.

    ``dedup="projected"`` compares the six typed columns. ``dedup="raw"`` compares all raw columns as they arrived,
    so rows that differ only in another column are both kept. ``None`` keeps every copy.

    All row-wise steps come before the duplicate removal, the only shuffle, so that it moves valid rows alone.
    In raw mode that changes nothing in the result: equal raw rows pass or fail the row-wise steps together.
    """
    complete = drop_nulls(df)
    if dedup == "raw":
        raw_columns = complete.columns
        slots = {f.name: f"__{f.name}" for f in TELEMETRY.fields}
        typed = complete.withColumns({slots[name]: column for name, column in _typed(complete).items()})
        valid = (
            typed.na.drop("any", subset=list(slots.values()))
            .where(_matches(slots["serial_number"], SERIAL_PATTERN, strict_ids))
            .where(_matches(slots["model"], MODEL_PATTERN, strict_ids))
        )
        return cast_project(dedup_rows(valid.select(*raw_columns)))
    if dedup not in ("projected", None):
        raise ValueError(f"dedup must be 'projected', 'raw' or None, not {dedup!r}")
    valid = filter_model(filter_serial(drop_nulls(cast_project(complete)), strict_ids), strict_ids)
    return dedup_rows(valid) if dedup else valid


def clean_groups(groups: Sequence[DataFrame], dedup: str | None = "projected", strict_ids: bool = False) -> DataFrame:
    """:func:`clean` over raw tables whose columns may differ in type, with duplicates removed across all of them.

    Rows of different types have no raw form in common, so ``dedup="raw"`` is refused.
    """
    if dedup not in ("projected", None):
        raise ValueError(f"dedup must be 'projected' or None for files of several types, not {dedup!r}")
    rows = reduce(DataFrame.unionByName, [clean(group, None, strict_ids) for group in groups])
    return dedup_rows(rows) if dedup else rows
