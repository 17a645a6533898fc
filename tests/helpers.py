from datetime import date

from spindlewatch.schema import TELEMETRY


def day(n: int) -> date:
    return date(2024, 1, n)


def telemetry(spark, rows):
    """Rows of (day of month, serial, model, failure, vault, hours)."""
    return spark.createDataFrame([(day(d), *rest) for d, *rest in rows], TELEMETRY)


def failures(spark, groups):
    """Telemetry with the given numbers of failures: {(day, model, vault): n}, one disk per failure."""
    return telemetry(spark, [
        (d, f"SN-{d}-{vault}-{i}", model, True, vault, 1.0)
        for (d, model, vault), n in groups.items() for i in range(n)
    ])


def plan_text(df) -> str:
    """The executed plan, after adaptive execution has run it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
