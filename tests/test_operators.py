import warnings

import pytest
from pyspark.sql import functions as F

from moraine.errors import SchemaVersionError, ValidationError
from moraine.functions import ids
from moraine.operators import aggregates as G
from moraine.operators import matrices as MX
from moraine.operators import filters as Q
from moraine.operators import joins as J
from moraine.operators import vetting as V
from moraine.operators import windows as W


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(2, 272, -540, 10, 0, True, 3), (3, 111, -216, 11, 0, False, 0), (3, 111, -216, 12, 0, None, None)], "h11 int, h12 int, chi int, ks_id long, triang_id long, has_gv boolean, n_conifolds long")


def test_mirror_query(catalog):
    rows = Q.mirror_query(catalog, h11=272, h12=2, has_conifolds=True).collect()
    assert [(r.h11, r.h12, r.ks_id, r.triang_id) for r in rows] == [(272, 2, 10, 0)] and "chi" not in rows[0]


def test_false_means_none_not_no_filter(catalog):
    assert [r.ks_id for r in Q.query_catalog(catalog, has_conifolds=False).collect()] == [11]
    assert [r.ks_id for r in Q.query_catalog(catalog, has_gv=False).collect()] == [11]


def test_filters_on_missing_columns(catalog):
    assert Q.query_catalog(catalog, max_tadpole=1).count() == 3
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert Q.query_catalog(catalog, nothing=1).count() == 3
    assert any("nothing" in str(x.message) for x in w)
    assert Q.tag_filter(catalog, include=["a"]).count() == 0
    assert Q.tag_filter(catalog, exclude=["a"]).count() == 3


def test_lookup(catalog):
    assert Q.lookup(catalog, ks_id=10).h12 == 272
    with pytest.raises(KeyError):
        Q.lookup(catalog, ks_id=99)
    with pytest.raises(ValueError, match="several"):
        Q.lookup(catalog, triang_id=0)
    with pytest.raises(TypeError):
        Q.check_key({"ks_id": "1"}, "ks_id")


def test_tags(spark):
    df = spark.createDataFrame([(1, "q_ge_100, ok"), (2, "ok;orphaned"), (3, None), (4, "q_ge_100|ok|new")], "i int, tags string")
    get = lambda **k: sorted(r.i for r in Q.tag_filter(df, **k).collect())
    assert get(include=["q_ge_100"]) == [1, 4]
    assert get(include=["ok", "new"], mode="any") == [1, 2, 4]
    assert get(include=["ok"], exclude=["orphaned"]) == [1, 4]


def test_flux_number_null_never_passes(spark):
    df = spark.createDataFrame([(1, 5.0, False), (2, None, None), (3, 50.0, True), (4, float("nan"), False)], "i int, N_flux double, retracted boolean")
    assert [r.i for r in Q.query_solutions(df, max_flux=10).collect()] == [1]
    assert sorted(r.i for r in Q.query_solutions(df, hide_retracted=True).collect()) == [1, 2, 4]
    assert [r.i for r in Q.query_solutions(df, limit=2, order=["i"]).collect()] == [1, 2]


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r.k for r in Q.sample(df, 10, 3, ["k"]).collect()]
    assert a == [r.k for r in Q.sample(df.repartition(7), 10, 3, ["k"]).collect()] and len(set(a)) == 10
    assert a != [r.k for r in Q.sample(df, 10, 4, ["k"]).collect()]
    with pytest.raises(ValueError):
        Q.sample(df, 101, 3, ["k"])
    assert Q.sample(df, 101, 3, ["k"], strict=False).count() == 100


def test_splits_keep_geometries_apart(spark):
    df = spark.range(40).select(F.concat(F.lit("g"), (F.col("id") % 20).cast("string")).alias("geometry_id"), F.array(F.lit(1), F.lit(2)).alias("flux"), F.lit("r").alias("run_id"))
    parts = {s: {r.geometry_id for r in Q.split_view(df, s).collect()} for s, _ in ids.DEFAULT_SPLITS}
    assert sum(map(len, parts.values())) == 20
    with pytest.raises(ValueError):
        Q.split_view(df, "dev")
    f = Q.features(df, pad_to={"flux": 4})
    assert set(f.columns) == {"geometry_id", "flux"} and list(f.first().flux) == [1, 2, -1, -1]


def test_links_and_refresh(spark):
    index = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, q int")
    source = spark.createDataFrame([(1, 5), (1, 5), (2, 9)], "k int, q int")
    assert {r.k: r.tdf_status for r in J.link_status(index, source, ["k"]).collect()} == {1: "ok", 2: "ok", 3: "orphaned"}
    assert [r.k for r in J.orphans(index, source, ["k"]).collect()] == [3]
    new, log = J.refresh(index, source, ["k"], ["q"])
    assert {r.k: r.q for r in new.collect()} == {1: 5, 2: 9, 3: 7}
    assert [(r.k, r.column, r.old, r.new) for r in log.collect()] == [(2, "q", "6", "9")]


def test_similarity(spark):
    rows = spark.createDataFrame([(1, [1, 2], [1.0], [0.0], 0.0, 2.0), (2, [1, 3], [0.0], [0.0], 0.0, 0.0), (3, [], [], [], 0.0, 2.0)], "id int, flux array<int>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double")
    assert [r.id for r in J.similar_to(rows, flux=[1, 2]).collect()] == [1]
    assert sorted(r.id for r in J.similar_to(rows, flux=[1, 2], flux_tol=1).collect()) == [1, 2]
    assert [r.id for r in J.similar_to(rows, moduli=[1 + 1e-7j]).collect()] == [1]
    assert sorted(r.id for r in J.similar_to(rows, tau=2j).collect()) == [1, 3]
    assert J.exists(rows, [1, 3]) and not J.exists(rows, [1, 3], id=1)


def test_curated_before_plain(spark):
    df = spark.range(4).withColumnRenamed("id", "k")
    c, p = spark.createDataFrame([(1, "c")], "k long, v string"), spark.createDataFrame([(1, "p"), (2, "p")], "k long, v string")
    assert {r.k: (r.v, r.gv_source) for r in J.curated_first(df, c, p, ["k"], ["v"]).collect()} == {0: (None, None), 1: ("c", "curated"), 2: ("p", "plain"), 3: (None, None)}


def test_order_of_events(spark):
    log = spark.createDataFrame([("a", 1, "running", 0), ("a", 1, "done", 1), ("b", 2, "running", 2)], "run_id string, k int, status string, seq long")
    assert {r.k: r.status for r in W.latest(log, ["k"], ["seq"]).collect()} == {1: "done", 2: "running"}
    assert {r.run_id: r.seq for r in W.first_of(log, ["run_id"], ["seq"]).collect()} == {"a": 0, "b": 2}


def test_merge_puts_null_first(spark):
    a = spark.createDataFrame([("r", None, 1)], "run_id string, finished_at long, started_at long")
    b = spark.createDataFrame([("r", 5, 1), ("s", None, 2)], "run_id string, finished_at long, started_at long")
    assert {r.run_id: r.finished_at for r in W.merge_logs(a, b).collect()} == {"r": 5, "s": None}


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("k"))
    assert sorted((r.k, r.id) for r in W.number_rows(df, ["k"], 5).collect()) == [(k, k + 5) for k in range(500)]
    assert W.number_rows(df.where("k < 0"), ["k"]).count() == 0


def test_summaries(spark, catalog):
    r = G.catalog_info(catalog).first()
    assert (r.n_models, r.min_h11, r.max_h12, r.n_has_gv, r.n_has_conifolds) == (3, 2, 272, 1, 1)
    assert G.catalog_info(catalog.where("h11 > 9")).first().n_models == 0
    assert G.next_id(catalog, "ks_id") == 13 and G.next_id(catalog.where("h11 > 9"), "ks_id") == 0
    a, b = catalog, catalog.repartition(3).orderBy(F.desc("ks_id"))
    assert G.key_fingerprint(a, "h11", "ks_id").first() == G.key_fingerprint(b, "h11", "ks_id").first()
    runs = spark.createDataFrame([("a", 1, 3, "x"), ("b", 1, 4, None), ("c", 2, 5, "x")], "run_id string, ks_id int, n_vacua long, method string")
    total, per = G.runs_info(runs, ["ks_id"])
    assert (total.first().n_vacua, total.first().n_models, total.first().methods) == (12, 2, {"unknown": 1, "x": 2}) and per.count() == 2


def test_eigenvalues(spark):
    df = spark.createDataFrame([([[2.0, 1.0], [1.0, 2.0]],), ([[1.0, float("nan")], [0.0, 1.0]],), ([],), (None,)], "m array<array<double>>")
    assert [None if r[0] is None else round(r[0], 9) for r in df.select(MX.least_eigenvalue("m")).collect()] == [1.0, None, None, None]
    assert [round(x, 9) for x in df.select(MX.spectrum("m")).first()[0]] == [1.0, 3.0]


ROWS = "flux array<double>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double, residual double, N_flux double, i int"


def solutions(spark):
    z = ([1.0], [1.0], 0.0, 2.0)
    return spark.createDataFrame([([1.0, 2.0], *z, 1e-9, 3.0, 0), ([1.0, 2.5], *z, 1e-9, 3.0, 1), ([3.0, 4.0], *z, 1.0, 3.0, 2), ([5.0, 6.0], None, [1.0], 0.0, 2.0, 1e-9, 3.0, 3), ([7.0, 8.0], *z, 1e-9, 99.0, 4)], ROWS)


def test_row_validation(spark):
    report = V.validate_rows(solutions(spark), tadpole=10, tol=1e-8).orderBy("i").collect()
    assert [r.passed for r in report] == [True, False, False, False, False]
    assert [r.errors for r in report][1:] == [["flux is not integral"], ["residual over the tolerance"], ["moduli_re is null"], ["tadpole over the bound"]]
    known = spark.createDataFrame([([1.0, 2.0],)], "flux array<double>")
    first = V.validate_rows(solutions(spark), known).orderBy("i").first()
    assert first.errors == ["already stored"]
    with pytest.raises(ValidationError):
        V.split_policy(V.validate_rows(solutions(spark), tol=1e-8), strict=True)
    good, bad = V.split_policy(V.validate_rows(solutions(spark), tol=1e-8), strict=False)
    assert good.count() == 2 and "error" in bad.columns
    assert V.validate_rows(solutions(spark).drop("tau_re")).where("passed").count() == 0


def test_designate_retract_purge(spark):
    from moraine.schemas import DESIGNATED

    empty = spark.createDataFrame([], DESIGNATED)
    identity = {"ks_id": 1, "h11": 2}
    with pytest.raises(ValidationError):
        V.designate(solutions(spark), empty, identity, "l", "me", "2024-01-01", ["i"])
    c, data = V.designate(solutions(spark), empty, identity, "l", "me", "2024-01-01", ["i"], tags=["x"], tadpole=10, force=True)
    assert [(r.designated_id, r.flux, r.tags, r.ks_id) for r in c.collect()] == [(0, [1, 2], '["x"]', 1)] and data.count() == 1
    again, _ = V.designate(solutions(spark), c, identity, "l", "me", "2024-01-01", ["i"], tadpole=10, force=True)
    assert again.count() == 0
    marked, audit = V.retract(c, [0, 5], "wrong", "me", "2024-01-01T00:00:00")
    assert [(r.designated_id, r.reason) for r in audit.collect()] == [(0, "wrong")] and marked.first().retracted
    assert V.retract(marked, [0], "again", "me", "2024")[1].count() == 0
    with pytest.raises(ValueError):
        V.purge(marked, data, dry_run=False)
    assert V.purge(marked, data)[0].count() == 1
    left, left_data, gone = V.purge(marked, data, 30, dry_run=False, confirm=True)
    assert (left.count(), left_data.count(), gone.count()) == (0, 0, 1)
    young = F.lit("2024-01-05").cast("timestamp")
    assert V.purge(marked, data, 30, dry_run=False, confirm=True, now=young)[0].count() == 1


SPEC = V.VerifierSpec("abc", ("kahler_metric_pd", "hessian_min_eig"), {"tol": 1e-6})


def test_review_of_a_submission(spark):
    rows = [(0, "g", [1.0, 2.0], 0.5, True), (1, "g", [1.2, 2.0], 0.5, True), (2, "g", [3.0, 4.0], -0.57, True), (3, "g", [9.0, 9.0], 0.5, True), (4, "h", [1.0, 2.0], 0.5, True)]
    df = spark.createDataFrame(rows, "i int, geometry_id string, flux array<double>, e double, is_susy boolean").withColumn("cert_status", F.lit("certified"))
    known = spark.createDataFrame([("g", [9.0, 9.0])], "geometry_id string, flux array<double>")
    make = lambda d: V.stability(d["e"], F.lit(0.0), F.lit(0.0), F.lit(2.0))
    good, bad = V.review(df, known, make, SPEC, ["i"])
    assert sorted(r.i for r in good.collect()) == [0, 4] and "is_susy" not in good.columns
    assert {r.i: r.reason for r in bad.collect()} == {1: "repeated in the submission", 2: "not certified", 3: "already stored"}
    assert {r.cert_status for r in good.collect()} == {"provisional"}
    with pytest.raises(ValidationError):
        V.review(df, known, make, V.VerifierSpec("abc", ("hessian_min_eig",)), ["i"])


def test_python_certifier_survives_a_failing_row(spark):
    df = spark.createDataFrame([(0, [1.0], "g"), (1, [2.0], "g")], "i int, flux array<double>, geometry_id string")

    def judge(row):
        if row["i"]:
            raise ValueError
        return {"passed": True, "checks": {"kahler_metric_pd": True}, "metric": 1.0, "hessian": 0.0, "mass": 0.0}

    good, bad = V.certify(df, V.python_certifier(judge, ["i"]), "v")
    r = good.first()
    assert (r.i, r.cert_checks, r.kahler_metric_min_eig) == (0, '{"kahler_metric_pd": true}', 1.0) and bad.first().cert_status is None


def test_verifiers():
    reg = V.VerifierRegistry([SPEC])
    assert reg.register(V.VerifierSpec("abc", SPEC.checks, {"tol": 1e-6}, notes="other")) == SPEC.verifier_id and len(reg) == 1
    assert V.VerifierRegistry.from_json(reg.to_json()).to_json() == reg.to_json()
    with pytest.raises(ValueError):
        V.VerifierRegistry.from_json(reg.to_json().replace('"abc"', '"abd"'))
    with pytest.raises(ValueError):
        V.VerifierSpec("a", ("b", "a"), vocabulary=("a", "b"))


def test_manifest_refuses_what_lacks_evidence(spark):
    base = spark.createDataFrame([(3, 2, "v", "certified", '{"kahler_metric_pd": true}', 0.1)] * 3 + [(5, 2, "v", "certified", '{"kahler_metric_pd": true}', 0.2)] * 2, "h11 int, h12 int, verifier_id string, cert_status string, cert_checks string, kahler_metric_min_eig double")
    shards = spark.range(2)
    m = G.manifest(base, shards).first().asDict()
    assert m["by_hodge"] == {"h11=3,h12=2": 3, "h11=5,h12=2": 2} and V.fully_certified(m)
    omitted = base.withColumn("cert_checks", F.lit("{}"))
    for bad in (omitted, base.drop("cert_checks"), base.drop("cert_status"), base.withColumn("kahler_metric_min_eig", F.lit(-0.57)), base.withColumn("cert_status", F.lit("provisional")), base.limit(0)):
        assert not V.fully_certified(G.manifest(bad, shards).first().asDict())


def test_schema_validation_tells_all_at_once(spark):
    df = spark.createDataFrame([("a b", "g", None, "odd"), ("ok", "h", [1], None)], "run_id string, geometry_id string, flux array<int>, cert_status string")
    with pytest.raises(ValidationError) as e:
        V.validate_schema(df)
    text = str(e.value)
    assert all(x in text for x in ("missing column tau_re", "null flux: 1", "no slugs: 1", "unknown cert_status: 1", "beyond one: 1"))
    assert issubclass(SchemaVersionError, RuntimeError)


def test_rows_that_tie_are_taken_once(spark):
    rows = spark.createDataFrame([("g", [1.0, 2.0], 1, "a"), ("g", [1.2, 2.0], 1, "b"), ("g", [1.0, 2.0], 1, "a"), ("h", [1.0, 2.0], 1, "a")], "geometry_id string, flux array<double>, place int, note string")
    good = lambda df: V.stability(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))
    taken, rejected = V.review(rows, rows.limit(0), good, V.VerifierSpec("b", ("kahler_metric_pd",)), ["place"])
    assert sorted(r["geometry_id"] for r in taken.collect()) == ["g", "h"]
    assert [r["reason"] for r in rejected.collect()] == ["repeated in the submission"] * 2


def test_a_missing_residual_is_over_any_tolerance(spark):
    rows = spark.createDataFrame([([1.0], 1e-9), ([2.0], None), ([3.0], float("nan")), ([4.0], 1.0)], "flux array<double>, residual double")
    told = lambda **k: [r["passed"] for r in V.validate_rows(rows, tol=1e-6, required=("flux",), **k).orderBy("flux").collect()]
    assert told() == [True, False, False, False]
    assert told(residual=F.col("flux")[0] - 4) == [False, False, False, True]
