"""Failure counts per day, vault and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failed_rows(df: DataFrame) -> DataFrame:
    return df.where("failure")


def count_failures(df: DataFrame, *keys: str) -> DataFrame:
    """Failures per ``keys`` in a telemetry table."""
    return failed_rows(df).groupBy(*keys).agg(F.count("*").alias("failures_count"))


def failures_by_day_vault(df: DataFrame) -> DataFrame:
    return count_failures(df, "event_date", "vault_id")


def failures_by_vault_model(df: DataFrame) -> DataFrame:
    """The partial both failure rankings start from: at most vaults x models rows."""
    return count_failures(df, "vault_id", "model")


def failures_by_day_vault_model(df: DataFrame) -> DataFrame:
    """The partial all three failure reports can start from, for a job that scans the table once for them."""
    return count_failures(df, "event_date", "vault_id", "model")


def regroup(partial: DataFrame, *keys: str) -> DataFrame:
    """Sum a failure-count partial up to coarser ``keys``."""
    return partial.groupBy(*keys).agg(F.sum("failures_count").alias("failures_count"))


def failures_by_model(partial: DataFrame) -> DataFrame:
    return regroup(partial, "model")


def failures_by_vault(partial: DataFrame) -> DataFrame:
    return regroup(partial, "vault_id")


def models_per_vault(partial: DataFrame) -> DataFrame:
    """Per vault the distinct failing models, in name order, joined with commas.

    The partial holds a model once per vault (and day), so a list is no longer than the number of models on sale.
    """
    return partial.groupBy("vault_id").agg(
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("list_of_models")
    )


def with_count_in(counts_df: DataFrame, counts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Groups with exactly one of the given failure counts."""
    return counts_df.where(F.col("failures_count").isin(*counts))
