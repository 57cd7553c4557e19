"""Streams with state against plain loops, and over a restart."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from moraine.sources import shards as H
from moraine.streaming import stateful as ST


def events(n=120, seed=3):
    rnd, t = random.Random(seed), datetime(2024, 1, 1)
    out = []
    for k in range(n):
        t += timedelta(seconds=rnd.randrange(1, 90))
        out.append((k, f"u{rnd.randrange(3)}", t, rnd.choice(["start", "start", "done", "failed"])))
    return out


SCHEMA = "event_id long, user string, ts timestamp, status string"


def write(spark, rows, path, n):
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def budget_of(rows, budget, window):
    held, out = {}, {}
    for i, u, t, _ in rows:
        own = [x for x in held.get(u, []) if x > t - timedelta(seconds=window)]
        out[i] = len(own) < budget
        held[u] = own + [t] * out[i]
    return out


def lifecycle_of(rows):
    held, out = {}, {}
    for i, u, _, s in rows:
        n, on = held.get(u, (0, False))
        if s == "start":
            held[u], out[i] = (n + 1, True), (n + 1, "restarted" if on else "started")
        else:
            held[u], out[i] = (n, False), (n, s if on else "ignored")
    return out


def test_state_survives_a_restart(spark, tmp_path):
    rows, src = events(), str(tmp_path / "in")
    write(spark, rows[:60], src, 3)
    for name, make, want, got in (
        ("budget", lambda s: ST.commit_budget(s, "user", "ts", "event_id", 4, 600), budget_of(rows, 4, 600), lambda r: r.accepted),
        ("life", lambda s: ST.run_lifecycle(s, "user", "ts", "event_id", "status"), lifecycle_of(rows), lambda r: (r.attempt, r.event)),
    ):
        out, check = str(tmp_path / f"out_{name}"), str(tmp_path / f"check_{name}")
        for step in (0, 1):
            if step and name == "budget":
                write(spark, rows[60:], src, 2)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
            q = ST.to_table(make(stream), out, check)
            assert q.awaitTermination(180)
        assert {r.id: got(r) for r in spark.read.parquet(out).collect()} == want


def test_only_complete_pairs_are_read(spark, tmp_path):
    root = tmp_path / "stage"
    rows = spark.range(3).select(F.array(F.col("id").cast("int"), F.lit(2)).alias("flux"), F.array(F.lit(1.0)).alias("moduli_re"), F.array(F.lit(1.0)).alias("moduli_im"), F.lit(0.0).alias("tau_re"), F.lit(2.0).alias("tau_im"), F.lit(5).alias("tadpole_charge"))
    a = H.write_shard(rows, root, "runA", {"h11": 3, "h12": 2, "ks_id": 1})
    b = H.write_shard(rows, root, "runB", {"h11": 3, "h12": 2, "ks_id": 2})
    side = (tmp_path / "held.json")
    os.replace(b.sidecar, side)  # data without its sidecar is not complete
    to, check = str(tmp_path / "table"), str(tmp_path / "check")
    assert ST.ingest_pairs(spark, str(root / "pending"), to, check).awaitTermination(120)
    assert {r.run_id for r in spark.read.parquet(to).select("run_id").collect()} == {"runA"}
    os.replace(side, b.sidecar)
    assert ST.ingest_pairs(spark, str(root / "pending"), to, check).awaitTermination(120)
    assert spark.read.parquet(to).groupBy("run_id").agg(F.count("*").alias("n")).count() == 2 and a.n_rows == 3
