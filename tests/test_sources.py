import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from moraine.errors import SchemaVersionError, ValidationError
from moraine.functions import ids
from moraine.sources import shards as H
from moraine.sources.catalog import Catalog, PhaseStore, list_files
from moraine.sources.snapshots import read_snapshot
from moraine.sources.runs import RunLog, SessionStore, read_fragments, write_fragment
from moraine.streaming.ingest import ingest, pending_stream, sessions, windowed_counts


def rows(spark, n, susy=None, first=0):
    df = spark.range(first, first + n).select(F.array(F.col("id").cast("int"), F.lit(2)).alias("flux"), F.array(F.lit(1.0)).alias("moduli_re"), F.array(F.lit(1.0)).alias("moduli_im"), F.lit(0.0).alias("tau_re"), F.lit(2.0).alias("tau_im"), F.lit(5).alias("tadpole_charge"))
    return df if susy is None else df.withColumn("is_susy", F.lit(susy))


@pytest.fixture
def staged(spark, tmp_path):
    a, b = {"h11": 3, "h12": 2, "ks_id": 1}, {"h11": 5, "h12": 2, "ks_id": 2}
    H.write_shard(rows(spark, 3, True), tmp_path, "run1", a, solver_name="newton")
    H.write_shard(rows(spark, 2, False), tmp_path, "run2", a, solver_name="newton")
    H.write_shard(rows(spark, 4), tmp_path, "run3", b)
    return tmp_path


def test_shards_write_publish_query(spark, staged, tmp_path):
    assert [x.n_rows for x in H.list_state(staged)] and len(H.list_state(staged)) == 3
    out = tmp_path / "published"
    report = H.sync(staged, H.FolderPublisher(out), H.CommitBudget(), max_batch=2)
    assert (report.n_synced, report.n_commits, report.n_failed) == (3, 2, 0) and len(H.list_state(staged, "synced")) == 3
    catalog, skipped = H.shard_catalog(spark, str(out))
    assert catalog.count() == 3 and skipped == 0
    assert H.query_shards(spark, catalog, h11=3).count() == 5
    # a shard without the column keeps its rows
    assert H.query_shards(spark, catalog, is_susy=True).count() == 3 + 4
    assert H.query_shards(spark, catalog, columns=["flux"], run_id="run2").columns == ["flux"]
    with pytest.raises(KeyError):
        H.query_shards(spark, catalog, columns=["nothing"])
    with pytest.raises(TypeError):
        H.query_shards(spark, catalog, cicy_id=1)


def test_shards_of_one_run_are_told_apart(spark, tmp_path):
    """One run, two geometries: files of one name, of which only one has the column."""
    H.write_shard(rows(spark, 2, False), tmp_path, "run", {"ks_id": 1})
    H.write_shard(rows(spark, 2, first=9), tmp_path, "run", {"ks_id": 2})
    out = tmp_path / "published"
    H.sync(tmp_path, H.FolderPublisher(out), H.CommitBudget())
    catalog, _ = H.shard_catalog(spark, str(out))
    assert sorted(r["flux"][0] for r in H.query_shards(spark, catalog, is_susy=True).collect()) == [9, 10]
    assert H.query_shards(spark, catalog, is_susy=False).count() == 4


def test_same_run_replaces_its_shard(spark, tmp_path):
    key = {"ks_id": 4}
    H.write_shard(rows(spark, 3), tmp_path, "r", key)
    H.write_shard(rows(spark, 5), tmp_path, "r", key)
    assert [x.n_rows for x in H.list_state(tmp_path)] == [5]


def test_refused_shards(spark, tmp_path):
    for run, key, df, error in (("a b", {"ks_id": 1}, rows(spark, 1), ValueError), ("r", {}, rows(spark, 1), ValueError), ("r", {"ks_id": 1}, rows(spark, 0), ValueError), ("r", {"ks_id": 1}, rows(spark, 1).drop("tau_re"), ValidationError)):
        with pytest.raises(error):
            H.write_shard(df, tmp_path, run, key)


def test_a_bad_file_is_told_and_skipped(spark, staged, tmp_path):
    out = tmp_path / "p"
    H.sync(staged, H.FolderPublisher(out), H.CommitBudget())
    (out / "bad.parquet").write_bytes(b"junk")
    with pytest.warns(UserWarning, match="cannot be read"):
        catalog, skipped = H.shard_catalog(spark, str(out))
    assert (catalog.count(), skipped) == (3, 1)


class Failing:
    def __init__(self, *errors):
        self.errors = list(errors)

    def commit(self, files):
        if self.errors:
            raise self.errors.pop(0)
        return "ok"


def test_sync_waits_and_gives_up(staged):
    waits = []
    r = H.sync(staged, Failing(H.RateLimited(7), H.Transient()), H.CommitBudget(), sleep=waits.append)
    assert waits == [7, 2] and r.n_synced == 3


def test_sync_sets_failed_batches_aside(staged):
    r = H.sync(staged, Failing(OSError("no"), OSError("no"), OSError("no")), H.CommitBudget(), max_batch=2, sleep=lambda s: None)
    assert (r.n_failed, r.n_synced) == (3, 0) and len(H.list_state(staged, "failed")) == 3


def test_budget(staged, tmp_path):
    b = H.CommitBudget(tmp_path / "b.json", budget=1)
    assert b.reserve(100.0) and not b.reserve(3700.0 - 0.5) and b.wait_s(3600.0) == 100.0
    assert H.CommitBudget(tmp_path / "b.json", budget=1).recent(3700.0) == 1 and b.reserve(3700.1)
    r = H.sync(staged, Failing(), H.CommitBudget(budget=1), max_batch=1)
    assert (r.n_synced, r.n_left) == (1, 2)
    assert H.parse_retry_after("5") == 5 and H.parse_retry_after("soon") is None
    with pytest.raises(ValueError):
        H.backoff(-1)


def test_snapshot(spark, staged, tmp_path):
    out = tmp_path / "p"
    H.sync(staged, H.FolderPublisher(out), H.CommitBudget())
    catalog, _ = H.shard_catalog(spark, str(out))
    df = H.query_shards(spark, catalog)
    with pytest.raises(ValidationError):
        H.freeze(spark, df, catalog, str(tmp_path / "snap"), "s1")
    told = H.freeze(spark, df, catalog, str(tmp_path / "snap"), "s1", require_certified=False)
    assert told["n_records"] == 9 and read_snapshot(spark, str(tmp_path / "snap"), "s1", verify=True).count() == 9
    with pytest.raises(FileExistsError):
        H.freeze(spark, df, catalog, str(tmp_path / "snap"), "s1", require_certified=False)


def test_catalog_and_pointers(spark, tmp_path):
    root = str(tmp_path / "tdf")
    spark.createDataFrame([(2, 272, -540, 10, 0, 0, 1), (3, 111, -216, 11, 0, 0, None)], "h11 int, h12 int, chi int, ks_id long, triang_id long, lcs_shard_id int, lcs_row_index long").write.parquet(f"{root}/catalog.parquet")
    spark.createDataFrame([(7,), (8,)], "c2 int").coalesce(1).write.parquet(f"{root}/tmp")
    part = next((tmp_path / "tdf/tmp").glob("part-*"))
    (tmp_path / "tdf/lcs_data").mkdir()
    part.rename(tmp_path / "tdf/lcs_data/data-00000.parquet")
    (tmp_path / "tdf/schema.json").write_text(json.dumps({"schema_version": 2}))
    with pytest.raises(SchemaVersionError):
        Catalog(spark, root, schema_version=1)
    c = Catalog(spark, f"{root}/lcs_data", schema_version=2)  # the parent has the marker
    (tmp_path / "tdf/schema.json").write_text("{}")
    with pytest.warns(UserWarning, match="no schema version"):
        Catalog(spark, root, schema_version=2)
    assert c.query(h11=272).first().ks_id == 10
    assert [(r.ks_id, r.c2) for r in c.load("lcs_data", "lcs_shard_id", "lcs_row_index").collect()] == [(10, 8)]
    with pytest.raises(ValueError):
        c.table("else")
    with pytest.raises(FileNotFoundError):
        c.table("conifold_catalog")


def test_phase_store(spark, tmp_path):
    def put(df, path, name="data-00000.parquet"):
        d = tmp_path / path
        df.coalesce(1).write.parquet(str(d / "t"))
        next((d / "t").glob("part-*")).rename(d / name)
        for f in (d / "t").iterdir():
            f.unlink()
        (d / "t").rmdir()

    (tmp_path / "schema.json").write_text(json.dumps({"schema_version": 3}))
    put(spark.createDataFrame([(2, 0, 0, 5, True, bytearray(b"ab"), 0, 0), (2, 0, 1, 5, False, bytearray(b"cd"), 0, 1), (2, 1, 0, 5, True, bytearray(b"ef"), 0, 2)], "h11 long, ks_id long, triang_id long, h12 long, fav_N boolean, wall_hash binary, geom_shard_id long, geom_row_index long"), "frst/catalog/h11_2")
    put(spark.createDataFrame([(0,)], "x int"), "frst/catalog/h11_2", "_ksid_index.parquet")
    put(spark.createDataFrame([(2, 0, 0, [1]), (2, 0, 1, [6]), (2, 1, 0, [3])], "h11 long, ks_id long, triang_id long, c2 array<long>"), "frst/geom/h11_2")
    put(spark.createDataFrame([(2, 0, 9), (2, 1, 8)], "h11 long, ks_id long, n_frsts long"), "polytope_catalog/h11_2")
    put(spark.createDataFrame([(2, 0, [1]), (2, 1, [2])], "h11 long, ks_id long, cy_basis array<long>"), "polytope/h11_2")
    put(spark.createDataFrame([(0, 4)], "ks_id long, n_vex long"), "polytope_vex_counts/h11_2")
    s = PhaseStore(spark, str(tmp_path))
    assert s.modes == ["frst"] and s.query("frst", 2).count() == 3
    r = s.query("frst", 2, ks_id=0, fav_n=False).first()
    assert (r.phase_id, r.wall_hash_hex) == ("frst:2:0:1", "6364")
    assert s.query("frst", 2, ks_id=77).count() == 0 and "phase_id" in s.query("frst", 2, ks_id=77).columns
    assert {x.ks_id: x.n_vex for x in s.query_polytopes(2).collect()} == {0: 4, 1: None}
    one = s.load("frst", 2, 0, 1).collect()
    assert len(one) == 1 and one[0].c2 == [6] and one[0].cy_basis == [1]
    assert {(x.mode, x.h11): x.n for x in s.info().collect()} == {("frst", 2): 3, ("frst", None): 3, (None, None): 3}
    assert any("_ksid_index" in f for f in list_files(spark, str(tmp_path)))
    with pytest.raises(ValueError):
        s.query("vex", 2)


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    t = datetime(2024, 1, 1, tzinfo=timezone.utc)
    a = log.start("class", 1, 2, now=t, host="x")
    log.finish(a, now=t, n_solutions=4)
    log.start("class", 1, 2, now=t)
    got = [(r.attempt_index, r.status, r.host) for r in log.list().collect()]
    assert got == [(1, "running", "x"), (1, "done", "x"), (2, "running", None)]
    assert [r.status for r in log.status().collect()] == ["running"]
    assert log.list(status="done").count() == 1
    for bad in (("class", 1, 2, 3), ("conifold", 1, 2), ("other", 1, 2)):
        with pytest.raises(ValueError):
            log.start(*bad)
    with pytest.raises(KeyError):
        log.finish("none")


def test_one_writer_at_a_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: RunLog(spark, path).start("class", 1, 2), range(4)))
    got = RunLog(spark, path).list().collect()
    assert sorted(r.attempt_index for r in got) == [1, 2, 3, 4] and sorted(r.seq for r in got) == [0, 1, 2, 3]


def test_sessions_dedup_within_a_model(spark, tmp_path):
    s = SessionStore(spark, str(tmp_path / "s"))
    df = rows(spark, 3).withColumn("vacuum_id", F.get("flux", F.lit(0)).cast("long"))
    run, n, skipped = s.write(df.union(df), {"ks_id": 1}, ["vacuum_id"])
    assert (n, skipped) == (3, 3) and s.load(run).count() == 3
    assert s.write(df, {"ks_id": 1}, ["vacuum_id"])[1:] == (0, 3)
    assert s.write(df, {"ks_id": 2}, ["vacuum_id"])[1] == 3
    assert s.runs.count() == 2  # no rows, no run
    assert s.delete(ks_id=1) == 1 and s.rows.count() == 3
    with pytest.raises(KeyError):
        s.load(run)
    out = s.write_models(df.withColumn("ks_id", F.get("flux", F.lit(0)) % 2), ["ks_id"], ["vacuum_id"])
    assert {r.ks_id: r.n_written for r in out.collect()} == {0: 2, 1: 1}


def test_fragments(spark, tmp_path):
    p = str(tmp_path / "f")
    for coni in (1, 2):
        write_fragment(spark.range(2), p, "pfv", "main", "r1", {"ks_id": 1, "coni_class_id": 0, "coni_id": coni}, window=[1, 2])
    assert read_fragments(spark, p, "pfv").count() == 4
    assert read_fragments(spark, p, "pfv", coni_id=2).first()["window"] == [1, 2]


def test_stream_ingest_is_repeatable(spark, staged, tmp_path):
    to = str(tmp_path / "table")
    for n in range(2):
        q = ingest(pending_stream(spark, str(staged / "pending")), to, str(tmp_path / f"cp{n}"))
        q.awaitTermination(120)
        assert spark.read.parquet(to).count() == 9


def test_windows_of_events(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00")], "u int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in windowed_counts(df, "ts", "u").collect()) == [1, 2]
    assert sorted(r.n for r in sessions(df, "ts", "u").collect()) == [1, 2]


def test_geometry_ids_of_shards_follow_their_keys(spark, staged):
    x = H.list_state(staged)[0]
    key = spark.range(1).select(ids.geometry_id(h11=3, h12=2, ks_id=1)).first()[0]
    assert key in {s.geometry_id for s in H.list_state(staged)} and x.run_id.startswith("run")
