"""The fleet reports as DataFrame functions over cleaned telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewatch.functions.percentiles import ACCURACY, stats_approx, stats_exact
from spindlewatch.operators.disks import disk_collapse
from spindlewatch.operators.failures import (
    failures_by_day_vault,
    failures_by_model,
    failures_by_vault,
    failures_by_vault_model,
    models_per_vault,
    regroup,
    with_count_in,
)
from spindlewatch.operators.ranking import top_k
from spindlewatch.schema import HOURS_STATS, TOP_MODELS, TOP_VAULTS, VAULT_DAYS


def vault_days(df: DataFrame, counts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Days on which a vault had exactly one of ``counts`` failures."""
    return VAULT_DAYS.sorted(with_count_in(failures_by_day_vault(df), counts))


def vault_days_from(partial: DataFrame, counts: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """As :func:`vault_days`, from a failure-count partial that has the day and the vault."""
    return VAULT_DAYS.sorted(with_count_in(regroup(partial, "event_date", "vault_id"), counts))


def top_models(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` models with the most failures."""
    return top_k(failures_by_model(failures_by_vault_model(df)), TOP_MODELS, k)


def top_models_from(partial: DataFrame, k: int = 10) -> DataFrame:
    return top_k(failures_by_model(partial), TOP_MODELS, k)


def top_vaults(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` vaults with the most failures, each with its distinct failing models."""
    return top_vaults_from(failures_by_vault_model(df), k)


def top_vaults_from(partial: DataFrame, k: int = 10) -> DataFrame:
    by_vault = partial.groupBy("vault_id").agg(
        F.sum("failures_count").alias("failures_count"),
        F.collect_set("model").alias("models"),
    )
    return (
        top_k(by_vault, TOP_VAULTS, k)
        .select("vault_id", "failures_count", F.array_join(F.array_sort("models"), ",").alias("list_of_models"))
    )


def rankings(df: DataFrame, k: int = 10) -> DataFrame:
    """Both failure rankings from one pass: (ranking, place, name, failures_count, list_of_models), where ranking is
    ``model`` or ``vault`` and models have no list.

    One aggregate over two grouping sets takes the place of two over a partial that is written for them. Only the ``k`` best
    of each task's groups go on to the tasks that number them.
    """
    sets = failures_by_vault_model(df).groupingSets([["model"], ["vault_id"]], "model", "vault_id")
    counted = sets.agg(
        F.grouping("model").alias("of_vault"), F.sum("failures_count").alias("failures_count"), F.collect_set("model").alias("models")
    )
    order = Window.partitionBy("of_vault").orderBy(F.desc("failures_count"), "model", "vault_id")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    vault = F.col("of_vault") == 1
    return best.select(
        F.when(vault, "vault").otherwise("model").alias("ranking"), "place",
        F.when(vault, F.col("vault_id").cast("string")).otherwise(F.col("model")).alias("name"), "failures_count",
        F.when(vault, F.array_join(F.array_sort("models"), ",")).alias("list_of_models"),
    )


def _hours_report(stats: DataFrame) -> DataFrame:
    named = stats.withColumn("failure", F.col("failure").cast("int")).select(*HOURS_STATS.schema.names)
    return HOURS_STATS.sorted(named)


def hours_stats(df: DataFrame, hours: str = "max", accuracy: int = ACCURACY) -> DataFrame:
    """Minimum, exact quartiles, maximum and number of disks, for never-failed (0) and failed (1) disks."""
    return _hours_report(stats_exact(disk_collapse(df, hours), accuracy=accuracy))


def hours_stats_approx(df: DataFrame, hours: str = "max", accuracy: int = ACCURACY) -> DataFrame:
    """As :func:`hours_stats`, with approximate quartiles: one pass over the disks."""
    return _hours_report(stats_approx(disk_collapse(df, hours), accuracy=accuracy))
