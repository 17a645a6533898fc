"""Statistics of disk hours, for failed and never-failed disks."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.schema import QUARTILES

ACCURACY = 10_000


def _fences(probs: Mapping[str, float], accuracy: int) -> list[float]:
    """Probabilities just below and just above each wanted one, by twice the sketch's rank error."""
    margin = 2.0 / accuracy
    return sorted({min(max(p + side * margin, 0.0), 1.0) for p in probs.values() for side in (-1, 1)})


def _decimal(p: float) -> str:
    """The shortest decimal that is ``p``, as a literal: ranks are whole exactly where the definition has them whole."""
    digits = format(Decimal(repr(p)), "f")
    if len(digits) > 20:
        raise ValueError(f"probability {p!r} has more than 18 decimals")
    return f"{digits}BD"


def stats_exact(
    disks: DataFrame,
    flag: str = "failure",
    value: str = "s9_power_on_hours",
    probs: Mapping[str, float] = QUARTILES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Minimum, exact percentiles, maximum and row count of ``value`` per boolean ``flag``.

    With n values in order, the percentile p is the mean of the values number n*p and n*p + 1 if n*p is whole,
    else the value number floor(n*p) + 1. Null values count as rows only.

    There are only two flags, so nothing here may gather a flag's values in one task. Instead:

    1. Equal values are counted: one row per (flag, value), spread over all tasks.
    2. An approximate percentile sketch places fences just around each wanted rank. They cut the value range into
       wide stretches between the percentiles and narrow ones around them.
    3. The counts of the stretches give, exactly, which one holds each wanted rank and how many values precede it.
    4. Only those stretches are sorted, each in its own task, to read off the values.

    The result is exact wherever the fences lie: the counts of the stretches and the stretches that are sorted come
    from the same sketch, which travels with the counts. Its error bound only decides how short the sorted stretches
    are: about ``6 / accuracy`` of a flag's rows. The frames that are broadcast have one row per value of a boolean,
    three at most.
    """
    if not isinstance(disks.schema[flag].dataType, T.BooleanType):
        raise TypeError(f"{flag} must be boolean: the broadcasts rely on at most three groups")
    if not all(0 < p < 1 for p in probs.values()):
        raise ValueError("probabilities must lie strictly between 0 and 1")

    fences = _fences(probs, accuracy)
    stretches = range(len(fences) + 1)
    readings = disks.select(F.col(flag).alias("flag"), F.col(value).cast("double").alias("value"))
    counted = readings.groupBy("flag", "value").agg(F.count("*").alias("n"))
    cuts = readings.groupBy("flag").agg(F.percentile_approx("value", fences, accuracy).alias("cuts"))

    # The stretch of a value is the number of fences below it; rows without a value go to stretch -1.
    fences_below = " + ".join(f"CAST(value > cuts[{i}] AS INT)" for i in range(len(fences)))
    stretch = F.expr(f"coalesce({fences_below}, -1)").alias("stretch")
    placed = (
        counted.join(F.broadcast(cuts.withColumnRenamed("flag", "cuts_flag")), F.expr("flag <=> cuts_flag"))
        .select("flag", "value", "n", "cuts", stretch)
    )

    # One row per flag: the size of each stretch, hence where each wanted rank lies.
    sizes = placed.groupBy("flag").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.sum("n").alias("rows"),
        F.first("cuts").alias("cuts"),
        F.expr("coalesce(sum(n) FILTER (WHERE stretch >= 0), 0)").alias("total"),
        *[F.expr(f"coalesce(sum(n) FILTER (WHERE stretch < {i}), 0) - "
                 f"coalesce(sum(n) FILTER (WHERE stretch < 0), 0)").alias(f"start_{i}") for i in stretches],
    )
    starts = ", ".join(f"start_{i}" for i in stretches)
    ranks = ", ".join(
        f"CAST(ceil(CAST(total AS DECIMAL(19, 0)) * {d}) AS BIGINT), "
        f"CAST(floor(CAST(total AS DECIMAL(19, 0)) * {d}) + 1 AS BIGINT)"
        for d in map(_decimal, probs.values())
    )
    located = (
        sizes.selectExpr("flag AS sizes_flag", "low", "high", "rows", "cuts", f"array({starts}) AS starts",
                         f"array({ranks}) AS ranks")
        .withColumn("holding", F.expr("transform(ranks, r -> size(filter(starts, s -> s < r)) - 1)"))
    )

    ranked = (
        counted.join(F.broadcast(located), F.expr("flag <=> sizes_flag"))
        .select("*", stretch)
        .where("stretch < 0 OR array_contains(holding, stretch)")
        .withColumn("last_rank", F.expr(
            "CASE WHEN stretch >= 0 THEN starts[stretch] + sum(n) OVER (PARTITION BY flag, stretch ORDER BY value "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END"
        ))
    )
    middle = {
        name: tuple(
            f"max(value) FILTER (WHERE ranks[{2 * i + side}] > last_rank - n AND ranks[{2 * i + side}] <= last_rank)"
            for side in (0, 1)
        )
        for i, name in enumerate(probs)
    }
    return ranked.groupBy(F.col("flag").alias(flag)).agg(
        F.first("low").alias("min"),
        *[F.expr(f"CASE WHEN {a} = {b} THEN {a} ELSE ({a} + {b}) / 2 END").alias(name)
          for name, (a, b) in middle.items()],
        F.first("high").alias("max"),
        F.first("rows").alias("count"),
    )


def percentiles_exact(
    disks: DataFrame,
    flag: str = "failure",
    value: str = "s9_power_on_hours",
    probs: Mapping[str, float] = QUARTILES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """The percentiles of :func:`stats_exact` alone."""
    return stats_exact(disks, flag, value, probs, accuracy).select(flag, *probs)


def stats_approx(
    disks: DataFrame,
    flag: str = "failure",
    value: str = "s9_power_on_hours",
    probs: Mapping[str, float] = QUARTILES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """As :func:`stats_exact` with approximate percentiles from one sketch; rank error at most n / accuracy."""
    if not isinstance(disks.schema[flag].dataType, T.BooleanType):
        raise TypeError(f"{flag} must be boolean")
    quantiles = F.percentile_approx(value, list(probs.values()), accuracy)
    return (
        disks.groupBy(flag)
        .agg(
            F.min(value).alias("min"),
            quantiles.alias("quantiles"),
            F.max(value).alias("max"),
            F.count("*").alias("count"),
        )
        .select(flag, "min", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(probs)], "max", "count")
    )
