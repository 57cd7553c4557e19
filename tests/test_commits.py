"""Commits by many writers, stores over them, and numbers of rows."""

import subprocess
import sys
import textwrap
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from moraine.operators import windows as W
from moraine.sources.commits import CommitLog, with_seq
from moraine.sources.runs import RunLog, SessionStore
from moraine.sources.shared import names_in, put_if_absent, read_bytes, write_bytes
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[1])
ENTRY = with_seq(T.StructType([T.StructField("who", T.StringType()), T.StructField("n", T.LongType())]))


def test_one_of_many_creates_a_file(spark, tmp_path):
    for k in range(50):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda w, k=k: put_if_absent(spark, f"{tmp_path}/{k}.json", str(w).encode()), range(8)))
        assert sum(won) == 1 and read_bytes(spark, f"{tmp_path}/{k}.json") == str(won.index(True)).encode()
    assert names_in(spark, str(tmp_path)) == sorted(f"{k}.json" for k in range(50))


@pytest.mark.parametrize("every", [1000, 5])
def test_every_commit_has_its_own_number(spark, tmp_path, every):
    def write(w):
        log = CommitLog(spark, str(tmp_path / "log"), ENTRY, every)
        for _ in range(4):
            log.commit(lambda old, rows: {"who": str(w), "n": len(rows)})

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    got = CommitLog(spark, str(tmp_path / "log"), ENTRY).read().collect()
    assert sorted(r.seq for r in got) == list(range(24)) and all(sum(r.who == str(w) for r in got) == 4 for w in range(6))


def test_writers_of_two_processes(spark, tmp_path):
    path = str(tmp_path / "log")
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from concurrent.futures import ThreadPoolExecutor
        from pyspark.sql import SparkSession
        from moraine.sources.runs import RunLog
        s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda _: [RunLog(s, {path!r}).start("class", 1, 2) for _ in range(10)], range(4)))
        s.stop()
    """
    other = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    while not names_in(spark, path) and other.poll() is None:
        pass
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: [RunLog(spark, path).start("class", 1, 2) for _ in range(10)], range(4)))
    assert other.wait(120) == 0
    got = RunLog(spark, path).read().collect()
    assert sorted(r.seq for r in got) == list(range(80)) and sorted(r.attempt_index for r in got) == list(range(1, 81))


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    path = str(tmp_path / "log")
    log = RunLog(spark, path, compact_every=3)
    a = log.start("class", 1, 2)
    write_bytes(spark, f"{path}/.left-by-a-dead-writer.tmp", b"{")
    log.finish(a)
    log.start("class", 1, 2)
    log.start("class", 1, 2)
    assert "compact-000000000003.json" in names_in(spark, path) and "000000000000.json" not in names_in(spark, path)
    # one that was slow takes a number that is below the segment
    slow = RunLog(spark, path)
    slow.log._listing = lambda held=slow.log._listing, first=[True]: (0, [], []) if first and first.pop() else held()
    slow.start("class", 9, 9)
    got = [(r.seq, r.attempt_index, r.ks_id) for r in RunLog(spark, path).list().collect()]
    assert got == [(0, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 1, 9)]
    with pytest.raises(TypeError):
        log.start("class", 1, 2, colour="red")


def test_logs_are_merged_when_pushed(spark, tmp_path):
    a, b = (RunLog(spark, str(tmp_path / x)) for x in "ab")
    x, y = a.start("class", 1, 2), b.start("class", 1, 3)
    a.push(str(tmp_path / "all"))
    b.push(str(tmp_path / "all"))
    a.finish(x)
    a.push(str(tmp_path / "all"))
    assert {r.run_id: r.status for r in spark.read.parquet(str(tmp_path / "all")).collect()} == {x: "done", y: "running"}


def fluxes(spark, *values):
    return spark.createDataFrame([([v, 1],) for v in values], "flux array<int>")


def test_writer_stores_all_or_nothing(spark, tmp_path):
    s = SessionStore(spark, str(tmp_path / "s"))
    with s.writer({"ks_id": 5}, method="m", max_rows=2) as w:
        for k in (1, 2, 3, 3):
            w.append(flux=[k, 1], colour="red")
        w.append_batch(fluxes(spark, 3, 4))
        w.append_batch([{"flux": [5, 1]}])
        assert w._spills == 3
    assert w.result[1:] == (5, 2) and s.load(w.run_id).count() == 5
    assert s.rows.where("flux[0] = 1").first().extra_data == '{"colour": "red"}'
    with pytest.raises(KeyError), s.writer({"ks_id": 5}, max_rows=1) as w:
        w.append(flux=[9, 1])
        raise KeyError
    with s.writer({"ks_id": 5}) as w:
        pass
    assert w.result[1:] == (0, 0) and s.runs.count() == 1 and s.rows.count() == 5
    assert not [n for n in names_in(spark, str(tmp_path / "s")) if n.startswith(".staging")]


def test_rows_without_a_commit_are_not_read(spark, tmp_path):
    s = SessionStore(spark, str(tmp_path / "s"))
    run, *_ = s.write(fluxes(spark, 1, 2).withColumn("k", F.lit(1)), {"ks_id": 1}, ["k"])
    s.rows.where("false").withColumn("run_id", F.lit("x")).write.mode("append").partitionBy("run_id").parquet(f"{s.root}/rows")
    s.rows.drop("run_id").withColumn("run_id", F.lit("dead")).write.mode("append").partitionBy("run_id").parquet(f"{s.root}/rows")
    assert s.rows.count() == 2
    s._remove = lambda ids: None  # the driver dies between the commit and the deletion
    assert s.delete() == 1 and s.rows.count() == 0
    assert SessionStore(spark, s.root).vacuum() == 1 and f"run_id={run}" not in names_in(spark, f"{s.root}/rows")


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 64])
def test_rows_of_uneven_width_keep_their_numbers(spark, tmp_path, adaptive, parts):
    path = str(tmp_path / "t")
    spark.range(0, 100_000, 1, parts).select("id", F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 768).otherwise(1)).alias("wide")).write.parquet(path)
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for c, v in zip(held, (adaptive, "200", "1m"), strict=True):
            spark.conf.set(c, v)
        out = W.number_rows(spark.read.parquet(path), ["k"], 7)
        got = out.select("id", "k").toPandas() if "id" in out.columns else None
        numbered = W.number_rows(spark.read.parquet(path), ["k"], 7, "place").select("place", "k", F.length("wide").alias("n")).toPandas().sort_values("k")
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert len(got) == 100_000 and list(numbered["place"]) == list(range(7, 100_007)) and sorted(numbered["n"].unique()) == [1, 768]


def test_rolling_counts_without_keys(spark):
    df = spark.createDataFrame([(k, f"2024-01-01 00:00:{s:02d}") for k, s in enumerate([0, 0, 5, 9, 30])] + [(9, None)], "id int, ts string")
    assert {r.id: r.n_recent for r in W.rolling_count(df, "ts", 5).collect() if r.id < 9} == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1}
    assert W.rolling_count(df, "ts", 5).count() == 6
