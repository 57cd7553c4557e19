"""Structured Streaming: shards as they arrive, sliding commits, late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moraine.schemas import PRODUCTION
from moraine.sources.shards import write_table


def pending_stream(spark: SparkSession, path: str, max_files: int = 500) -> DataFrame:
    """Rows of shards as their files appear, so many files a batch."""
    return spark.readStream.schema(PRODUCTION).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(path)


def ingest(stream: DataFrame, to: str, checkpoint: str, vet: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Put batches into the production table; a batch that is repeated replaces what it wrote.

    Runs until what is there now is done.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = vet(batch) if vet else batch
        write_table(rows, to)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rows of each key in each window; what comes later than ``late`` is left out of a stream."""
    w = F.window(F.col(ts).cast("timestamp"), window, slide) if slide else F.window(F.col(ts).cast("timestamp"), window)
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = marked.withWatermark(ts, late) if events.isStreaming else marked
    return marked.groupBy(w.alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows of each key between gaps."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    marked = marked.withWatermark(ts, late) if events.isStreaming else marked
    return marked.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first of equal keys within the time that late rows are waited for."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return marked.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)
