"""Queries on rows that the driver's small tables do not have, against their SQL."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from moraine.llm import lines, textkit, toxicity
from moraine.operators import similarity as S
from moraine.plans.queries import ORACLES, QUERIES


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over the given tables."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"select {','.join(got.columns)} from ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_conifolds_of_order_keys_over_a_million(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 3), (2_500_000, 1, 1), (7, 1, 2), (1_200_000, 2, 1)], "l_orderkey long, l_partkey long, l_linenumber int")
    got, want = both(spark, tmp_path, "all_conifolds", lineitem=rows)
    assert got == want and dict(got)[1] == "2000007,3000001,3500000"


def _orders(spark, n):
    o = spark.range(n).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 1511).alias("o_custkey"), F.element_at(F.array(F.lit("O"), F.lit("F")), (F.col("id") % 2 + 1).cast("int")).alias("o_orderstatus"),
        (F.col("id") * 48271 % 499979 + 0.25).alias("o_totalprice"), F.expr("timestamp'1995-01-01' + make_dt_interval(cast(id * 31 % 720 as int))").alias("o_orderdate"),
    )
    return o


@pytest.mark.parametrize("name", ["near_moduli", "near_flux", "near_tau"])
def test_near_pairs_are_compared_by_columns(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, orders=_orders(spark, 6000))
    assert got == want and want
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join Inner" in line]
    assert joins and not any("lambda" in j or "zip" in j for j in joins) and "array_max" not in plan


def test_narrow_cells_for_few_asked_rows(spark):
    v = spark.range(8000).select(F.lit(0).alias("m"), "id", *(F.expr(f"(id * {p}) % 997 / 10d").alias(c) for c, p in (("x", 7919), ("y", 104729), ("z", 48271))))
    f = [S.Feature(lambda p, c=c: F.col(f"{p}{c}"), 5.0) for c in "xyz"]
    few = v.where("id % 50 = 0")
    narrow = S.narrowed(f, few.count(), v.count())
    assert S.candidates(few, v, ["m"], narrow).count() < 0.5 * S.candidates(few, v, ["m"], f).count()
    assert S.narrowed(f, 8000, 8000) == f


def test_long_vectors_go_in_blocks(spark):
    rnd = random.Random(3)
    rows = [(i % 2, i, [rnd.gauss(0, 1) for _ in range(40 if i % 9 else 39)] if i % 50 else None if i % 100 else []) for i in range(1200)]
    rows += [(1, 1200 + i, [x + 0.1 for x in rows[7 * i + 1][2] or [0.0] * 40]) for i in range(40)]
    df = spark.createDataFrame(rows, "m int, id int, flux array<float>")
    rows = [(r.m, r.id, r.flux) for r in df.collect()]
    far = lambda a, b: max(abs(x - y) for x, y in zip(a, b))
    for tol in (0.2, 2.5, 4.0):
        out = S.near_flux(df, df, ["m"], tol)
        want = {(a[1], b[1], far(a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and a[2] and b[2] and len(a[2]) == len(b[2]) and far(a[2], b[2]) <= tol}
        got = [(r.a_id, r.b_id, r.distance) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
        assert "array_max" not in out._jdf.queryExecution().optimizedPlan().toString()
    gap = spark.createDataFrame([(0, 1, [1.0, None] * 10), (0, 2, [1.5, None] * 10), (0, 3, [3.0] * 20)], "m int, id int, flux array<double>")
    assert {(r.a_id, r.b_id) for r in S.near_flux(gap, gap, ["m"], 1).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_rarity_counts_every_document(spark, monkeypatch):
    monkeypatch.setattr(lines, "SAMPLE", 2, raising=False)
    docs = spark.createDataFrame([(i, "common words\nline common") for i in range(40)], "d long, text string")
    bucket = spark.range(1).select(lines._bucket(F.xxhash64(F.lit("common")))).first()[0]
    assert lines.rarity(docs).first().steps[bucket] >> 56 == int(3 * math.log2(81))


def test_line_verdicts_are_those_of_the_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7}\nseven eight nine ten w{i % 3} x y z", "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = __spark_entry__.queries()["op6_lines"](spark, str(tmp_path))
    sql = __spark_entry__.oracle_sql()["op6_lines"]
    names = [r[0] for r in c.execute(f"describe {sql}").fetchall()]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(c.execute(sql).fetchall())


def _learned_from(rows):
    return [(k, t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]


def test_toxicity_learns_from_every_labelled_document(spark):
    """13,000 labels, of which 9,750 are not held out, and no term tells anything: the bias is that of all."""
    rows = [(k, "sun rain", int(k % 7 == 0)) for k in range(13000)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    own = [y for *_, y in _learned_from(rows)]
    assert len(own) > 9000
    assert toxicity.train(docs, labels).bias == pytest.approx(math.log((sum(own) + 0.5) / (len(own) - sum(own) + 0.5)), abs=1e-12)


def test_toxicity_learns_from_long_documents(spark):
    rnd = random.Random(5)
    rows = [(k, f"{'sun rain ' * (12000 if k % 40 == 0 else 3)}{rnd.choice(['tree', 'road'])} {'grumbler' * (k % 40 == 0)}", int(k % 40 == 0)) for k in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    score = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert score == {k: y for k, _, y in rows}


def test_toxicity_in_parts(spark, monkeypatch):
    """Terms and pairs are those of a fit in memory; one part gives its machine, many give one that tells the same."""
    rnd = random.Random(6)
    rows = []
    for k in range(1600):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = [f"w{rnd.randrange(40)}" for _ in range(6)] + ["apple"] * a + ["bread"] * b
        rnd.shuffle(words)
        rows.append((k, " ".join(words), int(a == b)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    sets = [np.unique(toxicity.terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1]) for _, t, _ in _learned_from(rows)]
    want = toxicity.fit(sets, np.array([y for *_, y in _learned_from(rows)]))
    one = toxicity.train(docs, labels)
    assert one.buckets.tolist() == want.buckets.tolist() and len(want.buckets) >= 2
    assert np.allclose(one.weight, want.weight, atol=1e-3) and np.allclose(one.vector, want.vector, atol=1e-3)
    monkeypatch.setattr(toxicity, "PART", 300)
    many = toxicity.train(docs, labels)
    assert many.buckets.tolist() == want.buckets.tolist()
    right = [r.predicted == rows[r.doc_id][2] for r in toxicity.score(docs, many, 0.5).collect()]
    assert sum(right) > 0.95 * len(right)


def test_words_of_copies_are_not_put_in_order(spark, monkeypatch):
    """Each set of four words or more is ordered and written once, however many lines have it."""
    put, rows = textkit.Scratch.put, []

    def seen(self, df, *codec):
        out = put(self, df, *codec)
        if {"words", "rest"} <= set(out.columns):
            rows.append(out.count())
        return out

    monkeypatch.setattr(textkit.Scratch, "put", seen)
    docs = spark.createDataFrame([(i, f"one two three four five\nfour five one two three\nshort line\nsix seven eight nine w{i % 3}") for i in range(30)], "doc_id long, text string")
    out = lines.verdicts(docs)
    assert out.count() == 120 and out.where("removed").count() == 120 - 5
    assert rows == [4]
