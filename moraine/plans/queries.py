"""Queries that apply the operators to the driver's tables, and the same as DuckDB SQL.

The tables stand in for stored ones: part for a geometry catalogue (p_size as h11),
orders and customer for models, lineitem for solutions and tensor entries, events for run
logs, embeddings for flux vectors, pages for file paths, labels for certification.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import arrays as A
from moraine.functions import ids
from moraine.functions import text as X
from moraine.operators import aggregates as G
from moraine.operators import filters as Q
from moraine.operators import joins as J
from moraine.operators import sets as S
from moraine.operators import vetting as V
from moraine.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """part as a catalogue."""
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("ks_id"), F.col("p_size").alias("h11"), (51 - F.col("p_size")).alias("h12"), F.col("p_brand").alias("label"), (F.col("p_partkey") % 4).alias("n_conifolds"), (F.col("p_partkey") % 3 == 0).alias("has_gv"), F.col("p_retailprice").cast("long").alias("D3_tadpole"), (4 * F.col("p_size") - 102).alias("chi"), "p_name")


_PARTS = "parts as (select p_partkey ks_id, p_size h11, 51 - p_size h12, p_brand label, p_partkey % 4 n_conifolds, p_partkey % 3 = 0 has_gv, cast(trunc(p_retailprice) as bigint) D3_tadpole, 4 * p_size - 102 chi, p_name from part)"


@query(f"""with {_PARTS}, d as (select l_partkey ks_id, count(*) n_rows, cast(sum(l_quantity) as double) quantity from lineitem group by 1),
 k as (select ks_id, n_rows, quantity, cast(('0x' || substr(sha256(cast(ks_id as varchar)), 1, 16)) as ubigint) / 18446744073709551616.0 u from parts join d using (ks_id) where h11 between 10 and 40 and n_conifolds > 0)
 select case when u < 0.8 then 'train' when u < 0.9 then 'val' else 'test' end split, cast(sum(n_rows) as bigint) n_rows, count(*) n_keys, round(sum(quantity), 4) quantity from k group by 1""")
def catalog_split_summary(spark, d):
    """Filter a catalogue, join details, assign a split, sum up per split."""
    c = Q.query_catalog(_parts(spark, d), has_conifolds=True).where(F.col("h11").between(10, 40))
    detail = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ks_id")).agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"))
    both = c.select("ks_id").join(detail, "ks_id").withColumn("split", ids.assign_split("ks_id"))
    return both.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_keys"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query(f"with {_PARTS} select ks_id, h11, h12, n_conifolds, label from parts where n_conifolds = 0 and has_gv and D3_tadpole <= 1500 and label = 'Brand#12'")
def catalog_filter(spark, d):
    return Q.query_catalog(_parts(spark, d), has_conifolds=False, has_gv=True, max_tadpole=1500, label="Brand#12").select("ks_id", "h11", "h12", "n_conifolds", "label")


@query(f"with {_PARTS} select ks_id, h12 h11, h11 h12, label from parts where h11 = 7")
def mirror_swap(spark, d):
    return Q.mirror_query(_parts(spark, d), h12=7).select("ks_id", "h11", "h12", "label")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, o_custkey, o_orderpriority, c_mktsegment from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey and c_acctbal > 0")
def pointer_join(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.lit(0).alias("shard"))
    shards = _t(spark, d, "orders").select(F.lit(0).alias("shard_id"), F.col("o_orderkey").alias("row_index"), "o_custkey", "o_orderpriority")
    both = J.pointer_join(rows, shards, "shard", "l_orderkey").drop("shard")
    side = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.optional(both, side, ["o_custkey"])


@query("select doc_id, case when exists (select 1 from labels l where l.doc_id = d.doc_id) then 'ok' else 'orphaned' end tdf_status from documents d")
def link_status(spark, d):
    return J.link_status(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), ["doc_id"])


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def orphan_links(spark, d):
    return J.orphans(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), ["doc_id"])


@query("select p_partkey, n from part left join (select l_partkey, count(*) n from lineitem where l_returnflag = 'R' and l_quantity > 45 group by 1) on p_partkey = l_partkey")
def left_counts(spark, d):
    counts = _t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return Q.join_counts(_t(spark, d, "part").select("p_partkey"), counts, "p_partkey")


@query("select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def semi_ids(spark, d):
    keys = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


@query("""with q as (select vec_id query_id, embedding qe from embeddings where vec_id % 50 = 0)
 select query_id, vec_id, label from embeddings, q where list_max(list_transform(list_zip(embedding, qe), lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))) <= 0.5""")
def similar_linf(spark, d):
    """Every fiftieth vector against all of them."""
    v = _t(spark, d, "embeddings")
    # the label goes along with the id, as most pairs are found
    every = v.select(F.lit(0).alias("model"), F.struct("vec_id", "label").alias("id"), F.col("embedding").alias("flux"))
    near = J.similarity_join(every.where("id.vec_id % 50 = 0"), every, ["model"], "flux", 0.5)
    return near.select(F.col("a_id.vec_id").alias("query_id"), F.col("b_id.vec_id").alias("vec_id"), F.col("b_id.label").alias("label"))


@query("""select a.label, a.vec_id a_id, b.vec_id b_id, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))), 6) distance
 from embeddings a join embeddings b on a.label = b.label where list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(cast(z[1] as double) - cast(z[2] as double)))) <= 0.3""")
def similarity_pairs(spark, d):
    v = _t(spark, d, "embeddings")
    return J.similarity_join(v, v, ["label"], "embedding", 0.3, "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"with {_PARTS} select count(*) n_models, min(h11) min_h11, max(h11) max_h11, min(h12) min_h12, max(h12) max_h12, count(*) filter (has_gv) n_has_gv, round(100.0 * count(*) filter (has_gv) / count(*), 6) pct_has_gv, count(*) filter (n_conifolds > 0) n_has_conifolds, round(100.0 * count(*) filter (n_conifolds > 0) / count(*), 6) pct_has_conifolds from parts")
def catalog_info(spark, d):
    out = G.catalog_info(_parts(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("pct_has_gv", "pct_has_conifolds")})


@query("select l_returnflag, l_linestatus, count(*) n, grouping_id(l_returnflag, l_linestatus) as level from lineitem group by rollup (l_returnflag, l_linestatus)")
def hodge_rollup(spark, d):
    return G.counts_with_total(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("select coalesce(cast(toxic as varchar), 'unverified') status, count(*) n from documents left join labels using (doc_id) group by 1")
def manifest_hist(spark, d):
    both = J.optional(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id", "toxic"), ["doc_id"])
    return G.histogram(both, "toxic", name="status")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def latest_status(spark, d):
    return W.latest(_t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) attempt_index from events")
def attempt_index(spark, d):
    return W.attempt_index(_t(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""with a as (select user_id run_id, event_id, event_type status, case when event_type = 'view' then null else ts end finished_at, 0 src from events where value < 60),
 b as (select user_id run_id, event_id, event_type status, case when event_type = 'view' then null else ts end finished_at, 1 src from events where value >= 40)
 select run_id, event_id, status from (select *, row_number() over (partition by run_id order by finished_at desc nulls last, event_id desc, src desc) n from (select * from a union all select * from b)) where n = 1""")
def log_merge(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") != "view", F.col("ts")).alias("finished_at"), "value")
    return W.merge_logs(e.where("value < 60").drop("value"), e.where("value >= 40").drop("value"), order=["finished_at", "event_id"]).drop("finished_at")


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_quantity, l_extendedprice) n from lineitem) where n = 1")
def first_dedup(spark, d):
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return W.first_of(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


@query("select event_id, user_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts)) range between 3600 preceding and current row) n_recent from events")
def rolling_commits(spark, d):
    return W.rolling_count(_t(spark, d, "events").select("event_id", "user_id", "ts"), "ts", 3600, ["user_id"]).drop("ts")


@query("""with g as (select o_orderkey, substr(sha1('{"cicy_id":-1,"conifold_id":' || cast(o_custkey % 3 as varchar) || ',"h11":' || cast(o_custkey % 11 as varchar) || ',"h12":-1,"ks_id":' || cast(o_custkey as varchar) || ',"triang_id":-1}'), 1, 16) geometry_id from orders),
 u as (select *, cast(('0x' || substr(sha256(geometry_id), 1, 16)) as ubigint) / 18446744073709551616.0 u, cast(('0x' || substr(sha1(geometry_id), 1, 2)) as ubigint) % 16 b from g)
 select o_orderkey, geometry_id, cast(b as integer) bucket, case when u < 0.8 then 'train' when u < 0.9 then 'val' else 'test' end split from u""")
def ids_split(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", ids.geometry_id(ks_id="o_custkey", h11=F.col("o_custkey") % 11, conifold_id=F.col("o_custkey") % 3).alias("geometry_id"))
    return o.select("o_orderkey", "geometry_id", ids.bucket("geometry_id").alias("bucket"), ids.assign_split("geometry_id").alias("split"))


@query("""with k as (select o_custkey, count(*) n, cast(('0x' || substr(sha256(cast(o_custkey as varchar)), 1, 16)) as ubigint) / 18446744073709551616.0 u from orders group by 1)
 select case when u < 0.8 then 'train' when u < 0.9 then 'val' else 'test' end split, cast(sum(n) as bigint) n_rows, count(*) n_keys from k group by 1""")
def split_summary(spark, d):
    return G.split_summary(_t(spark, d, "orders"), "o_custkey", ids.assign_split("o_custkey"))


@query("select vec_id, list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 8, 0) as integer)) flux from embeddings")
def canonical_flux(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", ids.canonical_flux(F.transform("embedding", lambda x: x.cast("double") * 8)).alias("flux"))


_FLUX = "list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 8, 0) as integer))"


@query(f"""with g as (select vec_id, {_FLUX} flux, substr(sha1('{{"cicy_id":-1,"conifold_id":-1,"h11":' || cast(label as varchar) || ',"h12":-1,"ks_id":-1,"triang_id":-1}}'), 1, 16) g from embeddings)
 select vec_id, substr(sha1('{{"flux":[' || array_to_string(flux, ',') || '],"geometry_id":"' || g || '","verifier_id":"v1-0"}}'), 1, 24) record_id from g""")
def record_ids(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("flux"), ids.geometry_id(h11="label").alias("g"))
    return v.select("vec_id", ids.record_id("flux", "g", F.lit("v1-0")).alias("record_id"))


@query("""with t as (select l_orderkey % 50 g, l_partkey % 5 a, l_suppkey % 5 b, l_linenumber % 5 c, cast(l_quantity as bigint) - 25 v from lineitem),
 s as (select g, list_sort([a, b, c]) k, v from t)
 select g, k[1] i, k[2] j, k[3] k, cast(sum(v) as bigint) v from s group by g, k having sum(v) <> 0""")
def coo_canonical(spark, d):
    e = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("g"), (F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"), (F.col("l_linenumber") % 5).cast("long").alias("c"), (F.col("l_quantity").cast("long") - 25).alias("v"))
    return G.canonical_long(e, ["g"], "a", "b", "c", "v")


@query("""with t as (select p_partkey, [p_partkey % 7, p_size, length(p_name)] c from part)
 select p_partkey, cast(list_sum(list_transform(list_zip(c, [1, 2, 3]), lambda z: z[1] * z[2])) as bigint) degree from t where list_sum(list_transform(list_zip(c, [1, 2, 3]), lambda z: z[1] * z[2])) <= 90""")
def gv_truncate(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.array(F.col("p_partkey") % 7, F.col("p_size").cast("long"), F.length("p_name").cast("long")).alias("c"))
    grading = F.array(*(F.lit(x).cast("long") for x in (1, 2, 3)))
    kept = A.truncate_by_degree(F.array("c"), F.array("p_partkey"), grading, 90)
    return p.select("p_partkey", F.explode(kept).alias("x"), grading.alias("g")).select("p_partkey", A.dot(F.col("x.charge"), F.col("g")).alias("degree"))


@query("""with t as (select vec_id, list_transform(embedding[1:6], lambda x: cast(round_even(cast(x as double) * 8, 0) as bigint)) e from embeddings)
 select vec_id, [e[3], e[1], e[6]] c2, case when label_ok then [e[3] + e[1]] else [] end s from (select *, vec_id % 2 = 0 label_ok from t)""")
def basis_slice(spark, d):
    e = F.transform(F.slice("embedding", 1, 6), lambda x: F.rint(x.cast("double") * 8).cast("long"))
    v = _t(spark, d, "embeddings").select("vec_id", e.alias("e"))
    c2 = A.take("e", F.array(*map(F.lit, (2, 0, 5))))
    return v.select("vec_id", c2.alias("c2"), F.when(F.col("vec_id") % 2 == 0, F.array(F.get(c2, F.lit(0)) + F.get(c2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")).alias("s"))


@query("select vec_id, list_resize(embedding[1:cast(vec_id % 7 as bigint)], 5, cast(-1 as float)) padded from embeddings")
def pad_list(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 7).cast("int")).alias("e"))
    return v.select("vec_id", F.transform(A.pad("e", 5), lambda x: x.cast("float")).alias("padded"))


@query("select p_partkey, p_name from (select *, string_split(p_name, ' ') t from part) where list_has_any(t, ['red', 'blue', 'large']) and not list_has_any(t, ['small'])")
def tag_filter(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", F.regexp_replace("p_name", " ", ",").alias("tags"))
    return Q.tag_filter(p, ["red", "blue", "large"], ["small"], "any").drop("tags")


@query("select event_id, cast(json_extract(props, '$.k') as integer) k, json_extract_string(props, '$.none') missing from events")
def json_extract(spark, d):
    m = X.json_map("props")
    return _t(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).cast("int").alias("k"), F.try_element_at(m, F.lit("none")).alias("missing"))


@query("""select page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, regexp_extract(url, '([^/]+)$', 1) basename,
 case when lower(url) like '%nonsusy%' then 'nonsusy' when lower(url) like '%susy%' then 'susy' end susy, 'tdf/h12_' || cast(page_id % 9 as varchar) || '/ks_' || cast(page_id as varchar) || '_tri_' || cast(page_id % 4 as varchar) model_dir, page_id ks_id, page_id % 4 triang_id,
 case when page_id % 3 = 0 then 'rejected' when page_id % 2 = 0 then 'pending' else 'curated' end status, 'run' as label, page_id % 5 + 2 as version from pages""")
def path_parse(spark, d):
    p = _t(spark, d, "pages")
    root = X.model_dir(F.col("page_id") % 9, "page_id", F.col("page_id") % 4, F.lit(-1))
    where = F.when(F.col("page_id") % 3 == 0, "/community/_rejected/").when(F.col("page_id") % 2 == 0, "/community/user_").otherwise("/")
    path = F.concat(root, where, F.lit("run_v"), (F.col("page_id") % 5 + 2).cast("string"), F.lit(".parquet"))
    x = X.parse_path(path)
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/]+)$", 1).alias("basename"), X.guess_susy("url").alias("susy"), root.alias("model_dir"), x["ks_id"].alias("ks_id"), x["triang_id"].alias("triang_id"), x["status"].alias("status"), x["label"].alias("label"), x["version"].alias("version"))


@query("""select p_partkey, trim(regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9_-]+', '-', 'g'), '-') slug, strftime(timestamp '2024-01-02 03:04:05' + to_days(cast(p_size as integer)), '%Y-%m-%d-%H%M%S') as "day" from part""")
def slugify(spark, d):
    ts = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))
    return _t(spark, d, "part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), X.date_slug(ts).alias("day"))


@query("""select o_orderkey, cast((o_orderstatus = 'F')::int + (o_totalprice > 300000)::int + (o_custkey % 7 = 0)::int as integer) n_errors,
 (not (o_orderstatus = 'F' or o_totalprice > 300000 or o_custkey % 7 = 0)) passed from orders""")
def row_errors(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", V.errors_of((F.col("o_orderstatus") == "F", "final"), (F.col("o_totalprice") > 300000, "dear"), (F.col("o_custkey") % 7 == 0, "seventh")).alias("errors"))
    return o.select("o_orderkey", F.size("errors").alias("n_errors"), (F.size("errors") == 0).alias("passed"))


@query("""with c as (select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_discount >= 0.02 and l_tax <= 0.06),
 f as (select c.* from c where not exists (select 1 from orders o where o.o_orderkey = c.l_orderkey and o.o_orderstatus = 'P'))
 select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_quantity, l_extendedprice) n from f) where n = 1""")
def gate_pipeline(spark, d):
    rows = _t(spark, d, "lineitem").where("l_discount >= 0.02 and l_tax <= 0.06").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    stored = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return W.first_of(J.anti(rows, stored, ["l_orderkey"]), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


@query("select c_custkey, c_name from customer order by sha1(cast(c_custkey as varchar) || '|7'), c_custkey limit 20")
def sampled(spark, d):
    return Q.sample(_t(spark, d, "customer").select("c_custkey", "c_name"), 20, 7, ["c_custkey"])


@query("select p_partkey, p_brand, cast(null as varchar) p_type from part where p_size < 10 union all select p_partkey, null, p_type from part where p_size > 40")
def union_missing(spark, d):
    p = _t(spark, d, "part")
    return S.union_all(p.where("p_size < 10").select("p_partkey", "p_brand"), p.where("p_size > 40").select("p_partkey", "p_type"))


@query("""with t as (select s_suppkey k, s_nationkey a, s_suppkey % 4 b, s_suppkey % 3 c from supplier)
 select k, sha256('((' || cast(a as varchar) || ', ' || cast(b as varchar) || '), (' || cast(c as varchar) || ',))') h from t""")
def repr_hash(spark, d):
    s = _t(spark, d, "supplier")
    m = F.array(F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 4), F.array(F.col("s_suppkey") % 3))
    return s.select(F.col("s_suppkey").alias("k"), ids.normal_form_hash(m).alias("h"))


@query("""select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) + 99 as id from orders""")
def contiguous_ids(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return W.number_rows(o, ["o_totalprice", "o_orderkey"], 100).select("o_orderkey", "id")


@query("select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size desc, p_retailprice, p_partkey) - 1 as triang_id from part")
def triangulation_ids(spark, d):
    return W.triangulation_ids(_t(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], [F.col("p_size").desc(), "p_retailprice", "p_partkey"]).select("p_brand", "p_partkey", "triang_id")


@query("""select p_partkey, coalesce(c.v, p.v) v, case when c.v is not null then 'curated' when p.v is not null then 'plain' end gv_source
 from part left join (select l_partkey k, max(l_quantity) v from lineitem where l_returnflag = 'A' and l_quantity > 48 group by 1) c on p_partkey = c.k left join (select l_partkey k, min(l_quantity) v from lineitem where l_quantity > 30 group by 1) p on p_partkey = p.k""")
def curated_first(spark, d):
    items = _t(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    curated = items.where("l_returnflag = 'A' and l_quantity > 48").groupBy("p_partkey").agg(F.max("l_quantity").alias("v"))
    plain = items.where("l_quantity > 30").groupBy("p_partkey").agg(F.min("l_quantity").alias("v"))
    return J.curated_first(_t(spark, d, "part").select("p_partkey"), curated, plain, ["p_partkey"], ["v"])


@query("""select k, col as "column", old, new from (select o_orderkey k, 'status' col, o_orderstatus old, case when o_custkey % 5 = 0 then 'X' else o_orderstatus end new from orders) where old is distinct from new""")
def refresh_changes(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), "o_custkey")
    new = o.select("k", F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("status")).alias("status"))
    return J.refresh(o.select("k", "status"), new, ["k"], ["status"])[1]


@query("""select user_id, cast(epoch(date_trunc('hour', ts)) as bigint) start, count(*) n from events group by all""")
def tumbling_counts(spark, d):
    from moraine.streaming.ingest import windowed_counts

    return windowed_counts(_t(spark, d, "events"), "ts", "user_id").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("""with t as (select o_custkey, [o_orderkey % 3, o_orderkey % 2, o_orderkey % 3] idx, o_orderkey % 9 - 4 v from orders)
 select o_custkey, count(*) n, cast(sum(v) as bigint) total from t where list_contains([0, 2], idx[1]) and list_contains([0, 2], idx[2]) group by 1""")
def tensor_slice(spark, d):
    e = F.struct((F.col("o_orderkey") % 3).alias("i"), (F.col("o_orderkey") % 2).alias("j"), (F.col("o_orderkey") % 3).alias("k"), (F.col("o_orderkey") % 9 - 4).alias("v"))
    t = _t(spark, d, "orders").select("o_custkey", F.explode(A.basis_slice(F.array(e).cast(A.COO), F.array(F.lit(0), F.lit(2)))).alias("x"))
    return t.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("x.v").alias("total"))
