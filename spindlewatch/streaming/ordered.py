"""Raw files that arrive in the order of their days: duplicates removed with a bounded memory of rows.

:mod:`spindlewatch.streaming.ingest` is exact in any order and looks copies up in the table. Where files come in order, a
watermark over the days is cheaper: the state store holds the rows of the last ``delay`` only, and nothing is read back.
A row older than the watermark cannot be told from a copy and is dropped; how many were is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewatch.operators.cleaning import clean
from spindlewatch.schema import TELEMETRY
from spindlewatch.sources.tables import check_format

# One row for each run of the stream that dropped rows.
LATE_ROWS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("late_rows", T.LongType())])
_DAY = "__day"


def distinct_stream(raw: DataFrame, delay: str = "7 days") -> DataFrame:
    """The cleaned rows of a stream, each once; rows of days more than ``delay`` before the latest day of earlier batches
    are dropped. The day takes part in the comparison, so that the state of a passed day goes."""
    rows = clean(raw, dedup=None).withColumn(_DAY, F.col("event_date").cast("timestamp"))
    return rows.withWatermark(_DAY, delay).dropDuplicates([*TELEMETRY.names, _DAY]).drop(_DAY)


def ingest_ordered(raw: DataFrame, path: str, checkpoint: str, delay: str = "7 days", fmt: str = "parquet") -> int:
    """Clean every raw file that has arrived into the table at ``path``, then stop; the number of late rows dropped.

    With files in order of their days, late rows are copies and the table holds what a batch over all files would. With
    others, late rows may be missing from it: each is counted, copies of one row as often as they come. The count of a run is
    also appended below ``checkpoint``, see :func:`late_rows`; a run that breaks off loses its count, not its rows.
    """
    spark = raw.sparkSession
    query = (
        distinct_stream(raw, delay).writeStream.format(check_format(fmt)).partitionBy("event_date", "failure")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    # The session keeps the progress of the last hundred batches, so it is read while the stream runs.
    dropped: dict[int, int] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(1)
        for progress in query.recentProgress:
            late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
            dropped[progress.batchId] = max(late, dropped.get(progress.batchId, 0))
    total = sum(dropped.values())
    if total:
        spark.createDataFrame([(str(query.runId), total)], LATE_ROWS).write.mode("append").parquet(_log(checkpoint))
    return total


def _log(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-late-rows"


def late_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The numbers of late rows that the runs over ``checkpoint`` dropped; there is none before the first such run."""
    return spark.read.schema(LATE_ROWS).parquet(_log(checkpoint))
