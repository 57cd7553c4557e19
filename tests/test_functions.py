import hashlib
import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from moraine.functions import arrays as A
from moraine.functions import ids
from moraine.functions import text as X

rnd = random.Random(4)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_geometry_id_is_the_hash_of_compact_json(spark):
    rows = [(i, rnd.randrange(-1, 50), None if i % 5 == 0 else i * 7) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, h11 int, ks_id long")
    for i, h11, ks, got in df.select("i", "h11", "ks_id", ids.geometry_id(h11="h11", ks_id="ks_id")).collect():
        key = {"h11": h11, "h12": -1, "ks_id": -1 if ks is None else ks, "triang_id": -1, "conifold_id": -1, "cicy_id": -1}
        assert got == hashlib.sha1(json.dumps(key, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    with pytest.raises(TypeError):
        ids.geometry_id(h13=F.lit(1))


def test_flux_is_rounded_half_to_even(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4999, 3.0]
    got = one(spark, x=ids.canonical_flux(F.array(*map(F.lit, values))))["x"]
    assert got == [round(v) for v in values]


def test_record_id_and_bucket(spark):
    r = one(spark, r=ids.record_id(F.array(F.lit(1.0), F.lit(-2.0)), F.lit("g"), F.lit("v")), b=ids.bucket(F.lit("g"), 4), w=ids.bucket(F.lit("g"), 12))
    assert r["r"] == hashlib.sha1(b'{"flux":[1,-2],"geometry_id":"g","verifier_id":"v"}').hexdigest()[:24]
    byte = hashlib.sha1(b"g").digest()[0]
    assert (r["b"], r["w"]) == (byte & 15, byte)


def test_splits_follow_accumulated_breakpoints(spark):
    keys = [f"k{i}" for i in range(4000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = dict(df.select("k", ids.assign_split("k")).collect())
    for k in keys:
        u = int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") / 2**64
        assert got[k] == ("train" if u < 0.8 else "val" if u < 0.8 + 0.1 else "test")
    share = sum(v == "train" for v in got.values()) / len(got)
    assert abs(share - 0.8) < 4 * (0.8 * 0.2 / 4000) ** 0.5
    with pytest.raises(ValueError):
        ids.assign_split("k", [("a", 0.5)])


def test_hashes_of_tuples(spark):
    m = [[1], [2, -3]]
    coo = [(0, 1, 1, 5), (0, 0, 2, -1)]
    canon = sorted((*sorted(x[:3]), x[3]) for x in coo)
    r = one(
        spark, n=ids.normal_form_hash(F.array(*(F.array(*map(F.lit, row)) for row in m))),
        w=ids.wall_hash(F.lit(3), F.lit(4), A.canonical_coo(F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip("ijkv", x))) for x in coo))), F.array(F.lit(7))),
    )
    assert r["n"] == hashlib.sha256(repr(tuple(tuple(x) for x in m)).encode()).hexdigest()
    assert r["w"] == hashlib.sha256(repr((3, 4, tuple(canon), (7,))).encode()).hexdigest()


def coo_column(rows):
    return F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip("ijkv", x))) for x in rows)).cast(A.COO)


def test_tensors_against_python(spark):
    for _ in range(8):
        n = 4
        rows = [(*(rnd.randrange(n) for _ in range(3)), rnd.choice([-2, -1, 1, 2])) for _ in range(12)]
        basis = rnd.sample(range(n), 3)
        summed: dict = {}
        for i, j, k, v in rows:
            key = tuple(sorted((i, j, k)))
            summed[key] = summed.get(key, 0) + v
        want = sorted((*k, v) for k, v in summed.items() if v)
        place = {b: i for i, b in enumerate(basis)}
        sliced = [(place[i], place[j], place[k], v) for i, j, k, v in rows if {i, j, k} <= place.keys()]
        last = {tuple(sorted(x[:3])): x[3] for x in rows}
        dense = [last.get(tuple(sorted((a, b, c))), 0) for a in range(n) for b in range(n) for c in range(n)]
        r = one(spark, c=A.canonical_coo(coo_column(rows)), s=A.basis_slice(coo_column(rows), F.array(*map(F.lit, basis))), d=A.dense(coo_column(rows), n))
        assert [tuple(x) for x in r["c"]] == want
        assert [tuple(x) for x in r["s"]] == sliced
        assert list(r["d"]) == dense


def test_empty_tensor(spark):
    r = one(spark, c=A.canonical_coo(F.array().cast(A.COO)), d=A.dense(F.array().cast(A.COO), 2))
    assert r["c"] == [] and list(r["d"]) == [0] * 8


def test_source_normalisation_and_folding(spark):
    rows = [(0, 1, 1, 9), (1, 2, 2, 3), (2, 1, 2, 4)]
    x = one(spark, f=A.normalize_source("frst", coo_column(rows), F.array(*map(F.lit, (100, 5, 6))), F.array(F.lit(1), F.lit(2))))["f"]
    assert [tuple(e) for e in x["coo"]] == [(0, 1, 1, 7)] and x["c2"] == [5, 6] and x["c2_origin"] == 100 and x["basis"] == [0, 1]
    with pytest.raises(ValueError):
        A.normalize_source("tdf", F.lit(1), F.lit(1), F.lit(1))
    labels = A.prime_labels(F.array(F.lit(1), F.lit(2)))
    r = one(spark, l=labels, t=A.fold_tensor(coo_column([(0, 1, 2, 1), (0, 2, 1, 1), (0, 1, 1, 5)]), labels), v=A.fold_vector(F.array(*map(F.lit, (1, 2, 3))), labels))
    assert r["l"] == [0, 1, 1] and [tuple(e) for e in r["t"]] == [(0, 1, 1, 7)] and r["v"] == [1, 5]


def test_degrees(spark):
    charges = F.array(*(F.array(*map(F.lit, c)) for c in ([1, 0], [2, 1], [0, 3])))
    r = one(spark, x=A.truncate_by_degree(charges, F.array(*map(F.lit, (10, 20, 30))), F.array(F.lit(1), F.lit(1)), 2))["x"]
    assert [(x["charge"], x["value"]) for x in r] == [([1, 0], 10)]
    with pytest.raises(Exception, match="negative degree"):
        one(spark, x=A.truncate_by_degree(charges, F.array(*map(F.lit, (10, 20, 30))), F.array(F.lit(1), F.lit(-1)), 2))


def test_padding_and_numbers(spark):
    r = one(
        spark, p=A.pad(F.array(F.lit(1), F.lit(2)), 4), q=A.pad(F.array(F.lit(1), F.lit(2)), 1), i=A.is_integral(F.array(F.lit(1.0), F.lit(2.0000001))), j=A.is_integral(F.array(F.lit(1.5))),
        g=A.coupling(F.lit(0.0)), h=A.coupling(F.lit(5.0)), e=A.linf(F.array().cast("array<double>"), F.array().cast("array<double>")), u=A.linf(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))),
        b=A.exact_integers(F.array(F.lit("12"), F.lit("9" * 50))),
    )
    assert list(r["p"]) == [1, 2, -1, -1] and list(r["q"]) == [1] and r["i"] and not r["j"]
    assert r["g"] is None and r["h"] == 0.2 and r["e"] is None and r["u"] is None
    assert int(r["b"][0]["value"]) == 12 and r["b"][1]["value"] is None and r["b"][1]["text"] == "9" * 50


def test_paths(spark):
    paths = {
        "tdf/h12_2/ks_3_tri_4/run_v3.parquet": ("curated", 2, 3, 4, None, None, "run", 3),
        "tdf/h12_2/ks_3_tri_4/community/bob_run.parquet": ("pending", 2, 3, 4, None, None, "run", 1),
        "tdf/h12_2/ks_3_tri_4/community/_rejected/bob_run.parquet": ("rejected", 2, 3, 4, None, None, "bob_run", 1),
        "cicy/cicy_7/community/_rejected/a_b.parquet": ("pending", None, None, None, 7, None, "b", 1),
        "local/h12_2/model_9/x.parquet": ("curated", 2, None, None, None, 9, "x", 1),
        "custom/thing/x.parquet": ("curated", None, None, None, None, None, "x", 1),
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for p, x in df.select("p", X.parse_path("p").alias("x")).collect():
        assert (x["status"], x["h12"], x["ks_id"], x["triang_id"], x["cicy_id"], x["model_ID"], x["label"], x["version"]) == paths[p], p


def test_run_ids():
    now = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert X.render_run_id("{project}-{h11}-{seed?}-{date}", project="a b!", now=now, h11=3) == "a-b-3-na-2024-01-02-030405"
    with pytest.raises(KeyError):
        X.render_run_id("{h11}")
    for bad in ("{x.y}", "{x[0]}"):
        with pytest.raises(ValueError):
            X.render_run_id(bad, x=1)
    with pytest.raises(ValueError):
        X.render_run_id(lambda **k: "a__b")
    assert len(X.render_run_id()) == 32
    assert X.free_version("a", ["a.parquet", "a_v2.parquet", "a_v4.parquet"], "new_version") == "a_v3.parquet"
    with pytest.raises(FileExistsError):
        X.free_version("a", ["a.parquet"])


def test_slugs_tags_json(spark):
    r = one(
        spark, a=X.slugify(F.lit(" Ab  c/d- ")), b=X.slugify(F.lit("  ")), c=X.slugify(F.lit(None).cast("string")), t=X.tags_of(F.lit("a, b;c|a|")), j=X.json_tags(F.lit("nonsense")),
        s=X.is_safe_run_id(F.lit("a__b")), n=X.guess_susy(F.lit("x_nonsusy_1")), m=X.with_defaults(X.json_map(F.lit('{"a":"1"}')), a=F.lit("9"), b=F.lit("2")),
    )
    assert (r["a"], r["b"], r["c"], r["t"], r["j"], r["s"], r["n"]) == ("Ab-c-d", "na", "na", ["a", "b", "c"], [], False, "nonsusy")
    assert r["m"] == {"a": "1", "b": "2"}


@pytest.mark.parametrize(("checks", "e", "good"), [('{"kahler_metric_pd": true}', 0.1, True), ('{"kahler_metric_pd": "true"}', 0.1, False), ('{}', 0.1, False), (None, 0.1, False), ("junk", 0.1, False), ('{"kahler_metric_pd": true}', float("nan"), False), ('{"kahler_metric_pd": true}', float("inf"), False), ('{"kahler_metric_pd": true}', -0.57, False), ('{"kahler_metric_pd": true}', None, False)])
def test_metric_evidence(spark, checks, e, good):
    df = spark.createDataFrame([(checks, e)], "c string, e double")
    assert df.select(X.metric_passed("c", "e")).first()[0] is good


def test_old_enough(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-20",), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(A.older_than("t", 30, now)).collect()] == [True, False, False, False]
