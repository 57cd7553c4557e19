"""Row groups and their index, fingerprints of ranges, snapshots, batches of matrices and of physics."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.errors import ValidationError
from moraine.operators import fingerprints as FP
from moraine.operators import geometry as M
from moraine.operators import matrices as MX
from moraine.sources import rowgroups as R
from moraine.sources import snapshots as S
from moraine.sources.catalog import list_files

TABLE = "k long, name string, wide string"


@pytest.fixture
def indexed(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.format_string("n%05d", "id").alias("name"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    root = str(tmp_path / "t")
    df.repartitionByRange(4, "k").sortWithinPartitions("k").write.option("parquet.block.size", 1 << 16).option("parquet.page.size.row.check.min", 10).option("compression", "none").parquet(root)
    files = [f for f in list_files(spark, root, hidden=False)]
    for key in ("k", "name"):
        R.build_index(spark, files, key).coalesce(1).write.parquet(str(tmp_path / f"index_{key}"))
    return df, str(tmp_path), files


def test_index_of_row_groups(spark, indexed):
    df, at, files = indexed
    rows = spark.read.parquet(f"{at}/index_k").orderBy("first_row").collect()
    assert len(rows) > 40 and sum(r.n_rows for r in rows) == 20_000
    assert [r.first_row for r in rows] == np.cumsum([0, *(r.n_rows for r in rows)])[:-1].tolist()
    assert [r.low_number for r in rows] == [float(r.first_row) for r in rows]


def test_lookup_opens_one_group(spark, indexed):
    from pyspark.sql.datasource import EqualTo

    df, at, files = indexed
    reader = R.RowGroupReader(spark.createDataFrame([], TABLE).schema, {"index": f"{at}/index_k", "key": "k"})
    assert len(list(reader.pushFilters([EqualTo(("k",), 777)]))) == 1
    parts = reader.partitions()
    held = sum(b.num_rows for b in reader.read(parts[0]))
    size = sum((spark.sparkContext._jvm.java.io.File(f.replace("file:", "")).length()) for f in files)
    assert len(parts) == 1 and held < 1000 and reader.bytes_read < size / 10
    narrow = R.RowGroupReader(spark.createDataFrame([], "k long").schema, {"index": f"{at}/index_k", "key": "k"})
    list(narrow.pushFilters([EqualTo(("k",), 777)]))
    list(narrow.read(narrow.partitions()[0]))
    assert narrow.bytes_read < reader.bytes_read
    got = R.lookup(spark, f"{at}/index_k", "k", [777, 19_999, -1], TABLE)
    assert sorted(r.name for r in got.collect()) == ["n00777", "n19999"] and got.rdd.getNumPartitions() == 2
    text = R.lookup(spark, f"{at}/index_name", "name", ["n00777"], TABLE)
    assert [r.k for r in text.collect()] == [777] and text.rdd.getNumPartitions() == 1
    # a range, and a filter on another column
    every = R._format(spark).schema(TABLE).options(index=f"{at}/index_k", key="k").load()
    assert every.where("k >= 100 and k < 300 and name <> 'n00150'").count() == 199
    assert R._format(spark).options(index=f"{at}/index_k").load().count() == 20_000


def test_rows_by_place(spark, indexed):
    df, at, _ = indexed
    for a, b in ((0, 0), (0, 1), (990, 5010), (19_990, 30_000)):
        assert sorted(r.k for r in R.row_range(spark, f"{at}/index_k", a, b, "k long, absent int").collect()) == list(range(a, min(b, 20_000)))
    with pytest.raises(ValueError):
        R.row_range(spark, f"{at}/index_k", 5, 1, "k long")


def test_fingerprints_tell_ranges(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 11 > 0, F.lit("null")).alias("t"))
    leaf = F.floor(F.col("id") / 10)
    trees = [FP.tree(df.repartition(n), ["id", "v", "t"], leaf) for n in (1, 64)]
    roots = [FP.root(t).first() for t in trees]
    assert roots[0] == roots[1] and roots[0].n_rows == 5000 and FP.differing(*trees).count() == 0
    assert {r.level: r.n for r in trees[0].groupBy("level").agg(F.count("*").alias("n")).collect()} == {0: 500, 1: 2, 2: 1}
    other = FP.tree(df.where("id <> 17").withColumn("v", F.when(F.col("id") == 4000, 9).otherwise(F.col("v"))).union(df.where("id = 33")), ["id", "v", "t"], leaf)
    assert {(r.node, r.n_rows_a, r.n_rows_b) for r in FP.differing(trees[0], other).collect()} == {(1, 10, 9), (3, 10, 11), (400, 10, 10)}
    assert FP.root(other).first().digest != roots[0].digest
    nulls = FP.tree(df.withColumn("t", F.lit("null")), ["id", "v", "t"], leaf)
    assert FP.differing(trees[0], nulls).count() == 455  # a null is not the text
    assert FP.root(FP.tree(df.where("false"), ["id"], leaf)).count() == 0


def test_snapshots_outlive_writes(spark, tmp_path):
    data, snaps = str(tmp_path / "data"), str(tmp_path / "snaps")
    spark.range(10).write.parquet(data)
    told = S.freeze(spark, snaps, "one", list_files(spark, data, hidden=False), {"note": "x"})
    assert told["n_rows"] == 10 and told["note"] == "x"
    spark.range(5).write.mode("append").parquet(data)
    S.freeze(spark, snaps, "two", list_files(spark, data, hidden=False), hashes=False)
    assert S.read_snapshot(spark, snaps, "one", verify=True).count() == 10 and S.read_snapshot(spark, snaps, "two", verify=True).count() == 15
    assert S.names(spark, snaps) == ["one", "two"] and spark.read.parquet(data).count() == 15
    spark.range(1).coalesce(1).write.mode("append").parquet(data)
    left = S.unreferenced(spark, snaps, spark.createDataFrame([(f,) for f in list_files(spark, data, hidden=False)], "path string"))
    assert left.count() == 1
    with pytest.raises(FileExistsError):
        S.freeze(spark, snaps, "one", list_files(spark, data, hidden=False))
    with pytest.raises(ValidationError):
        S.freeze(spark, snaps, "three", [])
    with pytest.raises(KeyError):
        S.read_snapshot(spark, snaps, "none")
    file = sorted((tmp_path / "data").glob("part-*.parquet"))[0]
    listed = S.files_of(spark, snaps, "one").first().path.replace("file:", "")
    other = next(str(f) for f in (tmp_path / "data").glob("part-*.parquet") if str(f) != listed)
    with open(other, "rb") as a, open(listed, "wb") as b:
        b.write(a.read())
    with pytest.raises(ValidationError):
        S.read_snapshot(spark, snaps, "one", verify=True)
    assert file and json.loads((tmp_path / "snaps/one/manifest.json").read_text())["n_files"] >= 1


def test_matrices_in_batches(spark):
    rnd = np.random.default_rng(3)
    made = [rnd.normal(size=(k, k)) + 1j * rnd.normal(size=(k, k)) for k in rnd.integers(1, 5, 40)]
    rows = [(i, m.real.tolist(), m.imag.tolist()) for i, m in enumerate(made)]
    rows += [(100, [[1.0, 2.0]], [[0.0, 0.0]]), (101, [], []), (102, None, None), (103, [[float("nan")]], [[0.0]]), (104, [[1.0, 2.0], [3.0]], [[0.0]]), (105, [[2.0]], [[1.0, 1.0]]), (106, [[None]], [[1.0]])]
    df = spark.createDataFrame(rows, "i int, re array<array<double>>, im array<array<double>>").repartition(2)
    got = {r.i: r for r in df.select("i", MX.least_eigenvalue("re").alias("a"), MX.spectrum("re").alias("b"), MX.least_hermitian("re", "im").alias("c"), MX.hermitian_spectrum("re", "im").alias("d")).collect()}
    for i, m in enumerate(made):
        real, whole = np.linalg.eigvalsh((m.real + m.real.T) / 2), np.linalg.eigvalsh((m + m.conj().T) / 2)
        assert np.allclose(got[i].b, real) and np.allclose(got[i].d, whole) and np.isclose(got[i].a, real[0]) and np.isclose(got[i].c, whole[0])
    assert all(got[i].c is None and got[i].d is None for i in range(100, 107)) and got[105].a == 2.0 and got[100].b is None
    v = spark.createDataFrame([([3.0, 1.0],), ([],), ([None, 1.0],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(MX.least_of_vector("v")).collect()] == [1.0, None, None, None]
    cert = df.where("i < 40").select("i", MX.endpoint(F.col("re"), F.col("im"), F.col("re"), F.col("re"), F.lit(2.0)).alias("c")).collect()
    assert all(r.c.passed == bool(got[r.i].c > 1e-10 and got[r.i].a >= -1e-8) for r in cert)


class Arrays:
    """Physics of arrays of rows; fails where a flux is negative, and notes how often it is called."""

    calls = 0

    def tadpole(self, flux):
        return np.abs(flux).sum(axis=1)

    def superpotential(self, z, tau, flux):
        Arrays.calls += 1
        if (flux < 0).any():
            raise ValueError
        return z.sum(axis=1) * tau + flux[:, 0]

    def DW(self, z, tau, flux):
        return z - z[:, :1]

    def kahler_potential(self, z, tau):
        return np.full(len(tau), -1.0)

    def mass_matrix(self, z, tau, flux):
        return flux[:, :2, None] * np.eye(2)


class Rows(Arrays):
    """The same, of single rows."""

    def __getattribute__(self, name):
        if name.startswith("__"):  # what pickling asks for
            return object.__getattribute__(self, name)
        of = getattr(Arrays(), name)
        return lambda *x: of(*(np.asarray(v)[None] for v in x))[0]


def test_physics_in_batches(spark):
    rows = [(i, [float(i % 5), 2.0, 3.0] if i not in (40, 700) else [-1.0, 0.0, 0.0], [1.0] * (1 + i % 2), [0.5] * (1 + i % 2), 0.1, float(i % 3)) for i in range(1000)] + [(1000, None, [1.0], [1.0], 0.1, 1.0)]
    df = spark.createDataFrame(rows, "i int, flux array<double>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double").coalesce(1)
    whole = M.complete_missing(df, Arrays(), batch=1024).orderBy("i").collect()
    one = M.complete_missing(df, Rows()).orderBy("i").collect()
    assert whole == one and whole[40].W_re is None and whole[1000].g_s is None and whole[41].mass2 == [1.0, 2.0]
    frame = df.where("i < 700 and i % 2 = 0 and i <> 40").toPandas()
    Arrays.calls = 0
    M._derived(frame, [], lambda key: Arrays(), True, 1e-6, 1024)
    assert Arrays.calls == 1


def test_batches_of_models(spark):
    from moraine.operators.iterate import batches

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.struct(F.col("id").alias("x")).alias("detail")).repartition(5)
    made = list(batches(df, ["k"], 64, 100))
    assert [len(b) for b in made] == [64] * 15 + [40] and [r.k for b in made for r in b] == list(range(1000)) and made[0][1].detail.x * 7 % 1000 == 1
    assert list(batches(df.where("false"), ["k"])) == [] and next(batches(df, ["k"], 3, prefetch=False))[2].k == 2
    with pytest.raises(ValueError):
        next(batches(df, ["k"], 0))
