import pytest
from pyspark.sql import functions as F

from moraine.__main__ import main
from moraine.errors import ValidationError
from moraine.operators import geometry as M
from moraine.sources import files as V

ROW = "flux array<double>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double, ks_id long, triang_id long, is_susy boolean, residual double"


def rows(spark, flux=2.0, ks=3):
    return spark.createDataFrame([([1.0, flux], [1.0], [1.0], 0.0, 2.0, ks, 4, True, 1e-9)], ROW)


@pytest.fixture
def store(spark, tmp_path):
    d = "tdf/h12_2/ks_3_tri_4"
    V.push(rows(spark), tmp_path, d, "run", "me")
    V.push(rows(spark), tmp_path, f"{d}/community", "bob_run", "bob")
    V.push(rows(spark, 2.5).union(rows(spark)), tmp_path, d, "part", "me", strict=False)
    return tmp_path, d


def test_push_and_fetch(spark, store):
    root, d = store
    with pytest.raises(FileExistsError):
        V.push(rows(spark), root, d, "run", "me")
    assert V.push(rows(spark), root, d, "run", "me", "new_version")["file"].endswith("run_v2.parquet")
    assert V.push(rows(spark), root, d, "run", "me", "append")["n_rows"] == 1
    for bad in (("no slug!", "me"), ("ok", "")):
        with pytest.raises(ValidationError):
            V.push(rows(spark), root, d, *bad)
    with pytest.raises(ValidationError):
        V.push(rows(spark, 2.5), root, d, "x", "me")
    got = V.fetch(spark, str(root), d, "run")
    assert got.count() == 3 and {r[0].rpartition("/")[2] for r in got.select("_source_path").collect()} == {"run.parquet", "run_v2.parquet"}
    assert V.fetch(spark, str(root), d, community=True).count() == 5
    with pytest.raises(FileNotFoundError):
        V.fetch(spark, str(root), d, "nothing")


def test_catalog_has_rejected_files(spark, store):
    root, d = store
    c = {r.file_path: r for r in V.rebuild_catalog(spark, str(root)).collect()}
    assert {k.rpartition(d + "/")[2]: (r.status, r.n_rows) for k, r in c.items()} == {"run.parquet": ("curated", 1), "community/bob_run.parquet": ("pending", 1), "part.parquet": ("curated", 1), "_rejected/part.parquet": ("rejected", 1)}
    r = c[f"{d}/run.parquet"]
    assert r.checksum == V.sha256(root / d / "run.parquet") and (r.ks_id, r.triang_id, r.h12) == (3, 4, 2)
    assert V.browse(V.rebuild_catalog(spark, str(root)), status="pending").count() == 1


def test_validation_and_report(spark, store):
    root, d = store
    rows(spark).union(rows(spark, ks=9)).coalesce(1).write.parquet(str(root / "two"))
    two = next((root / "two").glob("part-*")).rename(root / "two.parquet")
    (root / "junk.parquet").write_bytes(b"x")
    report = V.validate_files(spark, [str(two), str(root / "junk.parquet")])
    got = {r.path.rpartition("/")[2]: r.errors for r in report.collect()}
    assert got["junk.parquet"] == ["cannot be read"] and "more than one model" in got["two.parquet"] and "schema version None" in got["two.parquet"]
    told, text, code = V.change_report(report)
    assert told["n_failed"] == 2 and code == 1 and "junk" in text


def test_promotion(store):
    root, d = store
    assert V.curate(root, f"{d}/community/bob_run.parquet").name == "run_v2.parquet"
    with pytest.raises(ValueError):
        V.curate(root, f"{d}/run.parquet")


def test_cache(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("12345")
    (tmp_path / "keep").mkdir()
    (tmp_path / "keep/y").write_text("1")
    told = []
    assert V.cache_size(tmp_path, 3, told.append) == 6 and told
    with pytest.raises(RuntimeError):
        V.clear_cache(tmp_path, offline=True)
    assert V.clear_cache(tmp_path, keep=["keep"]) == 5 and (tmp_path / "keep/y").exists()


def test_command_line(tmp_path, capsys):
    assert main(["status", "--staging", str(tmp_path)]) == 0 and "pending 0" in capsys.readouterr().out
    assert main(["sync", "--staging", str(tmp_path), "--to", str(tmp_path / "out")]) == 0


class Physics:
    def tadpole(self, flux):
        return abs(flux).sum()

    def superpotential(self, z, tau, flux):
        if flux[0] == 9:
            raise ValueError
        return 2 + 3j

    def DW(self, z, tau, flux):
        return [1e-9, 0]

    def kahler_potential(self, z, tau):
        return 0.0

    def mass_matrix(self, z, tau, flux):
        return [[4.0, 0.0], [0.0, 1.0]]


def test_derived_columns(spark):
    df = spark.createDataFrame([([1.0, -2.0, 5.0], [1.0], [1.5], 0.1, 5.0, None), ([9.0, 0.0, 0.0], [1.0], [1.5], 0.1, 5.0, 7.0)], "flux array<double>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double, N_flux double")
    a, b = M.complete_missing(df, Physics()).collect()
    assert (a.N_flux, a.g_s, a.W_im, a.is_susy, a.mass2) == (8.0, 0.2, 3.0, True, [1.0, 4.0]) and abs(a.m_gravitino - 13**0.5) < 1e-12
    assert b.N_flux == 7.0 and b.W_re is None
    with pytest.raises(ValueError):
        M.complete_missing(df, None)


class Shifted(Physics):
    def __init__(self, by):
        self.by = by

    def tadpole(self, flux):
        return self.by


def test_each_model_has_its_own_physics(spark):
    df = spark.createDataFrame([(k % 3, [1.0], [1.0], [1.5], 0.1, 5.0) for k in range(12)], "ks_id long, flux array<double>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double").repartition(2)
    got = M.by_model(df, lambda key: Shifted(100 * key["ks_id"]), ["ks_id"]).collect()
    assert len(got) == 12 and all(r.N_flux == 100 * r.ks_id for r in got)


def test_phase_accessors(spark):
    df = spark.createDataFrame([(2, 5, [0, 0], [0, 1], [1, 1], [3, 4], [10, 20], [1])], "h11 long, h12 long, intnums_coo_i array<long>, intnums_coo_j array<long>, intnums_coo_k array<long>, intnums_coo_v array<long>, c2 array<long>, cy_basis array<long>")
    r = M.tensors(df, layout="dense").first()
    assert list(r.kappa) == [0, 3, 3, 4, 3, 4, 4, 0]
    assert M.tensors(df, in_basis=True).first().kappa == [] and M.second_chern(df, True).first().c2_out == [20]
    with pytest.raises(Exception, match="does not cover"):
        M.full_tensors(df).collect()
    assert len(M.with_wall_hash(df).first().wall_hash) == 32
    with pytest.raises(Exception, match="chi"):
        M.checked_phases(df.withColumn("mode", F.lit("frst")).withColumns({"ks_id": F.lit(1), "triang_id": F.lit(0), "chi": F.lit(7)})).collect()


def test_many_files_in_one_scan(spark, tmp_path):
    """Files of several schemas are told apart, and a type that differs is cast."""
    d = tmp_path / "v/h12_1/ks_3_tri_4"
    base = spark.range(3).select(F.array(F.col("id").cast("int"), F.lit(2)).alias("flux"), F.array(F.lit(1.0)).alias("moduli_re"), F.array(F.lit(1.0)).alias("moduli_im"), F.lit(0.5).alias("tau_re"), F.lit(2.0).alias("tau_im"), F.lit(3).alias("ks_id"), F.lit(4).alias("triang_id"))

    def put(name, df):
        df.coalesce(1).write.parquet(str(tmp_path / "w" / name))
        (d / name).parent.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "w" / name).glob("part-*")).rename(d / name)
        return str(d / name)

    paths = [
        put("a.parquet", base), put("b.parquet", base.withColumn("ks_id", F.col("ks_id").cast("long")).withColumn("flux", F.col("flux").cast("array<double>"))),
        put("c.parquet", base.withColumn("flux", F.array(F.lit(0.5)))), put("d.parquet", base.withColumn("triang_id", F.monotonically_increasing_id())), put("e.parquet", base.drop("tau_re")),
        put("f.parquet", base.drop("ks_id", "triang_id")), put("g.parquet", base.where("false")), put("community/h.parquet", base), put("i.parquet", base.withColumn("is_susy", F.lit(True))), put("j.parquet", base.withColumns({"is_susy": F.lit(True), "residual": F.lit(1.0)})),
    ]
    (d / "k.parquet").write_bytes(b"no parquet")
    out = {r.path.rpartition("/")[2][0]: r for r in V.validate_files(spark, [*paths, str(d / "k.parquet")], physics="auto").collect()}
    version = "schema version None"
    assert {k: [e for e in r.errors if e != version] for k, r in out.items()} == {
        "a": [], "b": [], "c": ["3 rows: flux is not integral"], "d": ["more than one model"], "e": ["missing columns ['tau_re']"], "f": ["no identity"], "g": ["no rows"],
        "h": ["a submission's name starts with its user"], "i": [], "j": ["3 rows: residual over the tolerance"], "k": ["cannot be read"],
    }
    assert all(version in r.errors for k, r in out.items() if k != "k") and out["a"].n_rows == 3 and not out["a"].passed
