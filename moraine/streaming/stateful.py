"""Streams with state of their own: a budget of commits, the lifecycle of runs, shards with their sidecars.

State is kept by key with Spark's ``transformWithState`` and survives a restart with the stream's
checkpoint.  Rows of a key are taken in the order of their times within a batch; a stream's
batches must come in that order, as files of a log do.  State is bounded: a budget holds as many
times as it allows commits, a run is a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store; a session that names one keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, ROCKSDB)


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch in the order of their times."""
    return pd.concat(list(frames), ignore_index=True).sort_values(["at_us", "row_id"], kind="stable")


class _Budget(StatefulProcessor):
    """Accepts a row if fewer than ``budget`` were accepted in the ``window_us`` before it."""

    def __init__(self, budget: int, window_us: int) -> None:
        self.budget, self.window = budget, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.times.get()[0]) if self.times.exists() else []
        own, out = _rows(rows), []
        for i, ts in zip(own["row_id"].tolist(), own["at_us"].tolist(), strict=True):
            held = [t for t in held if t > ts - self.window]
            accepted = len(held) < self.budget
            if accepted:
                held.append(int(ts))
            out.append((key[0], i, accepted, self.budget - len(held)))
        self.times.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["key", "id", "accepted", "remaining"])

    def close(self) -> None:
        pass


class _Lifecycle(StatefulProcessor):
    """Numbers the attempts of a key: one that starts ends the one before it, if that runs still."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", T.StructType([T.StructField("attempt", T.LongType()), T.StructField("running", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, running = tuple(self.run.get()) if self.run.exists() else (0, False)
        own, out = _rows(rows), []
        for i, status in zip(own["row_id"].tolist(), own["row_status"].tolist(), strict=True):
            if status == "start":
                told, attempt, running = ("restarted" if running else "started"), attempt + 1, True
            elif running:
                told, running = status, False
            else:
                told = "ignored"
            out.append((key[0], i, int(attempt), told))
        self.run.update((int(attempt), bool(running)))
        yield pd.DataFrame(out, columns=["key", "id", "attempt", "event"])

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, ts: str, id_col: str, processor: StatefulProcessor, schema: str, **more) -> DataFrame:
    use_state_store(events.sparkSession)
    own = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(id_col).cast("long").alias("row_id"), *(F.col(c).alias(n) for n, c in more.items()))
    return own.where("key is not null and at_us is not null").groupBy("key").transformWithStateInPandas(processor, schema, "Append", "None")


def commit_budget(events: DataFrame, key: str, ts: str, id_col: str, budget: int, window_s: float) -> DataFrame:
    """key, id, accepted and remaining for every event: at most ``budget`` accepted ones in any ``window_s`` seconds.

    An event that is turned down does not count.  Events without a key or a time have no rows.
    """
    return _stateful(events, key, ts, id_col, _Budget(budget, int(window_s * 1e6)), "key string, id long, accepted boolean, remaining long")


def run_lifecycle(events: DataFrame, key: str, ts: str, id_col: str, status: str) -> DataFrame:
    """key, id, attempt and event (started, restarted, the status that ends a run, or ignored) for every event.

    ``start`` begins an attempt; any other status ends the one that runs.
    """
    return _stateful(events, key, ts, id_col, _Lifecycle(), "key string, id long, attempt long, event string", row_status=status)


def complete_pairs(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int = 500) -> DataFrame:
    """Rows of data files as their sidecars appear: a shard is complete with its JSON, which is written last.

    The stream is of the sidecars; ``path`` and what a sidecar tells come with each.  ``read_pairs`` reads the data of a batch.
    """
    told = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.json").option("multiLine", "true").json(path)
    return told.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", ".parquet"))


def read_pairs(batch: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the data files that a batch of sidecars names."""
    paths = [r[0] for r in batch.select("path").distinct().collect()]  # as many as files of a batch
    return batch.sparkSession.read.schema(schema).parquet(*paths) if paths else batch.sparkSession.createDataFrame([], schema)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a folder of batches, each replaced if it is repeated, until what is there is done."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_pairs(spark: SparkSession, source: str, to: str, checkpoint: str, max_files: int = 500) -> StreamingQuery:
    """Put the shards of a staging folder into the production table as they are complete; a repeated batch replaces what it wrote."""
    from moraine.schemas import PRODUCTION
    from moraine.sources.shards import write_table

    def put(batch: DataFrame, _: int) -> None:
        write_table(read_pairs(batch, PRODUCTION), to)

    told = complete_pairs(spark, source, "run_id string, geometry_id string, n_rows long", max_files)
    return told.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
