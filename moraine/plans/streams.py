"""Streams over the driver's events, run until what is there is done, with the SQL of the same in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.plans.queries import query
from moraine.plans.stored import _place
from moraine.sources.shared import file_system
from moraine.streaming import ingest as IN
from moraine.streaming import stateful as ST


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, p = file_system(spark, path)
    # a stream is of a folder
    return reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", "events.parquet").parquet(d)


def _done(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@query("""with e as (select event_id, user_id, case when event_type = 'view' then 'start' else event_type end status, ts from events),
 l as (select *, coalesce(lag(status) over (partition by user_id order by ts, event_id) = 'start', false) running, count(*) filter (status = 'start') over (partition by user_id order by ts, event_id rows unbounded preceding) attempt from e)
 select cast(user_id as varchar) "key", event_id id, attempt, case when status = 'start' then case when running then 'restarted' else 'started' end when running then status else 'ignored' end "event" from l""")
def stream_lifecycle(spark, d):
    """Every user's runs by a stream with state: attempts are counted, a start ends the run before it."""
    e = _stream(spark, d).withColumn("status", F.when(F.col("event_type") == "view", "start").otherwise(F.col("event_type")))
    root = _place(spark, "lifecycle")
    _done(ST.to_table(ST.run_lifecycle(e, "user_id", "ts", "event_id", "status"), f"{root}/rows", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/rows").drop("batch")


@query()
def stream_budget(spark, d):
    """Which events a budget of three in two hours lets through for every user; it depends on what it let through before, which SQL cannot say."""
    root = _place(spark, "budget")
    _done(ST.to_table(ST.commit_budget(_stream(spark, d), "user_id", "ts", "event_id", 3, 7200), f"{root}/rows", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/rows").drop("batch")


@query("""select cast(epoch(date_trunc('hour', ts)) as bigint) start_s, event_type, count(*) n from events group by 1, 2""")
def stream_windows(spark, d):
    """Events by type and hour, as a stream that keeps all windows."""
    root = _place(spark, "windows")
    counts = IN.windowed_counts(_stream(spark, d), "ts", "event_type", "1 hour").select(F.col("start").cast("long").alias("start_s"), "event_type", "n")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows")

    _done(counts.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(f"{root}/rows")
