"""Queries that write tables as the library stores them, into the shared folder, and read them back.

Each takes whole tables of the driver's and goes through the store's own writers and readers.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import text as X
from moraine.operators import aggregates as G
from moraine.operators import filters as Q
from moraine.operators import fingerprints as FP
from moraine.operators import geometry as M
from moraine.operators import joins as J
from moraine.operators import matrices as MX
from moraine.operators import similarity as SIM
from moraine.operators import vetting as V
from moraine.plans.queries import _t, query
from moraine.sources import rowgroups as R
from moraine.sources import runs as RUNS
from moraine.sources import shards as SH
from moraine.sources import snapshots as SN
from moraine.sources.catalog import Catalog, PhaseStore, list_files, rows_of_shard
from moraine.sources.shared import file_system, names_in, shared_dir, write_bytes


def _place(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            fs, p = file_system(spark, path)
            fs.delete(p, True)

    atexit.register(forget)
    return path


def _numbered(df: DataFrame, path: str, parts: int, *order: str) -> None:
    """A split: files ``data-NNNNN.parquet`` of ranges of an order."""
    spark = df.sparkSession
    temp = f"{path}-written"
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(temp)
    fs, target = file_system(spark, path)
    fs.mkdirs(target)
    for k, name in enumerate(n for n in names_in(spark, temp) if n.endswith(".parquet")):
        fs.rename(file_system(spark, f"{temp}/{name}")[1], file_system(spark, f"{path}/data-{k:05d}.parquet")[1])


# --- row groups ---------------------------------------------------------------------


def _indexed(spark: SparkSession, d: str) -> tuple[str, str]:
    """lineitem in many row groups in the order of its orders: (its index, its schema)."""
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = items.columns
    root = _place(spark, "lineitem")
    items.repartitionByRange(8, *order).sortWithinPartitions(*order).write.option("parquet.block.size", 1 << 16).option("parquet.page.size.row.check.min", 10).parquet(f"{root}/rows")
    R.build_index(spark, list_files(spark, f"{root}/rows", hidden=False), "l_orderkey").coalesce(1).write.parquet(f"{root}/index")
    return f"{root}/index", items.schema


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (3, 70, 1234)")
def point_lookup(spark, d):
    """Three orders by the key index: only the row groups that can hold them are opened."""
    index, schema = _indexed(spark, d)
    return R.lookup(spark, index, "l_orderkey", [3, 70, 1234], schema).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) n from lineitem) where n > 100 and n <= 1100")
def row_range(spark, d):
    """A thousand rows by their place over all files."""
    index, schema = _indexed(spark, d)
    return R.row_range(spark, index, 100, 1100, schema)


@query("select count(*) n_rows, min(l_orderkey) low, max(l_orderkey) high from lineitem")
def shard_keys(spark, d):
    """Counts and key ranges from footers alone."""
    index, _ = _indexed(spark, d)
    return spark.read.parquet(index).agg(F.sum("n_rows").alias("n_rows"), F.min("low_number").cast("long").alias("low"), F.max("high_number").cast("long").alias("high"))


# --- fingerprints and snapshots -----------------------------------------------------

_LINE = "'=' || l_orderkey || '|=' || l_linenumber || '|=' || l_partkey || '|=' || l_suppkey"
_LANES = ", ".join(f"sum(cast(('0x' || substr(h, {16 * k + 1}, 16)) as ubigint)::hugeint) l{k}" for k in range(4))


@query(f"""with h as (select l_orderkey // 500 node, sha256({_LINE}) h from lineitem),
 s as (select node, count(*) n_rows, {_LANES} from h group by 1)
 select node, n_rows, sha256(n_rows || '|' || l0 || '|' || l1 || '|' || l2 || '|' || l3) digest from s""")
def range_fingerprints(spark, d):
    """A digest of every 500 orders' lines, however they are dealt to tasks."""
    items = _t(spark, d, "lineitem")
    return FP.leaves(items, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.floor(F.col("l_orderkey") / 500)).withColumnRenamed("leaf", "node")


@query("select l_orderkey // 100 node, count(*) n_rows_a, nullif(count(*) filter (l_returnflag <> 'R' or l_quantity < 49), 0) n_rows_b from lineitem group by 1 having count(*) filter (l_returnflag = 'R' and l_quantity >= 49) > 0")
def differing_ranges(spark, d):
    """Ranges of orders that two states of a table do not have alike."""
    items = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    leaf = F.floor(F.col("l_orderkey") / 100)
    left = items.where("l_returnflag <> 'R' or l_quantity < 49")
    return FP.differing(FP.tree(items, items.columns, leaf), FP.tree(left, items.columns, leaf))


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def snapshot_rows(spark, d):
    """A snapshot read after more rows were written beside it."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    root = _place(spark, "snapshot")
    o.repartition(4, "o_custkey").write.parquet(f"{root}/data")
    SN.freeze(spark, f"{root}/snapshots", "first", list_files(spark, f"{root}/data", hidden=False))
    o.withColumn("o_totalprice", F.lit(0.0)).write.mode("append").parquet(f"{root}/data")
    return SN.read_snapshot(spark, f"{root}/snapshots", "first", verify=True)


# --- catalogues and splits ----------------------------------------------------------


def _catalog(spark: SparkSession, d: str) -> Catalog:
    """part as a catalogue whose rows point into a split of their details."""
    root = _place(spark, "catalog")
    p = _t(spark, d, "part")
    _numbered(p.select(F.col("p_partkey").alias("ks_of_row"), "p_name", "p_retailprice"), f"{root}/lcs_data", 4, "ks_of_row")
    write_bytes(spark, f"{root}/schema.json", json.dumps({"schema_version": 2}).encode())
    files = spark.read.parquet(*(f for f in list_files(spark, f"{root}/lcs_data")))
    where = files.select("ks_of_row", F.regexp_extract(F.col("_metadata.file_path"), r"data-(\d+)", 1).cast("int").alias("lcs_shard_id"), F.col("_metadata.row_index").alias("lcs_row_index"))
    cat = p.select(F.col("p_partkey").alias("ks_id"), F.col("p_size").alias("h12"), (F.lit(51) - F.col("p_size")).alias("h11"), (4 * F.col("p_size") - 102).alias("chi"), (F.col("p_partkey") % 4).alias("n_conifolds"), F.lit(0).alias("triang_id"))
    cat.join(where, cat["ks_id"] == where["ks_of_row"], "left").drop("ks_of_row").write.parquet(f"{root}/catalog.parquet")
    return Catalog(spark, root, schema_version=2)


@query("select p_partkey ks_id, p_size h11, 51 - p_size h12 from part where p_size = 11 and p_partkey % 4 > 0")
def stored_catalog(spark, d):
    """A stored catalogue in the mirror convention, filtered by h11 and conifolds."""
    return _catalog(spark, d).query(h11=11, has_conifolds=True).select("ks_id", "h11", "h12")


@query("select p_partkey ks_id, p_name, p_retailprice from part")
def pointed_rows(spark, d):
    """Every catalogue row with the split's row that it points to."""
    return _catalog(spark, d).load("lcs_data", "lcs_shard_id", "lcs_row_index").select("ks_id", "p_name", "p_retailprice")


@query("select p_partkey ks_id, p_name from part join (select distinct l_partkey from lineitem where l_quantity > 49.5) on p_partkey = l_partkey")
def pointed_rows_of_keys(spark, d):
    """Rows of some keys: only the shards that they point into are opened."""
    keys = _t(spark, d, "lineitem").where("l_quantity > 49.5").select(F.col("l_partkey").alias("ks_id")).distinct()
    return _catalog(spark, d).load("lcs_data", "lcs_shard_id", "lcs_row_index", keys, ["ks_id"]).select("ks_id", "p_name")


@query("select p_partkey ks_of_row, p_name from part where p_retailprice > 910")
def shard_rows_by_mask(spark, d):
    """Rows of each shard of a split by a condition, shards in their order."""
    split = _catalog(spark, d).split("lcs_data")
    parts = [rows_of_shard(split, k, F.col("p_retailprice") > 910) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("ks_of_row", "p_name")


def _phases(spark: SparkSession, d: str) -> PhaseStore:
    """part as phases of p_size % 5, suppliers as their polytopes, in the sharded layout."""
    root = _place(spark, "phases")
    p = _t(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("h11"), (F.col("p_partkey") % 100).cast("long").alias("ks_id"), F.floor(F.col("p_partkey") / 100).cast("long").alias("triang_id"), F.col("p_size").cast("long").alias("h12"), (F.col("p_partkey") % 2 == 0).alias("fav_N"), F.lit(None).cast("binary").alias("wall_hash"), F.array(F.col("p_size").cast("long")).alias("c2"))
    p = p.withColumn("h11", F.col("ks_id") % 5)  # a polytope has one h11
    write_bytes(spark, f"{root}/schema.json", json.dumps({"schema_version": 3}).encode())
    for h in range(5):
        own = p.where(F.col("h11") == h)
        _numbered(own.drop("c2"), f"{root}/frst/catalog/h11_{h}", 2, "ks_id", "triang_id")
        _numbered(own.select("h11", "ks_id", "triang_id", "c2"), f"{root}/frst/geom/h11_{h}", 2, "ks_id", "triang_id")
        polytopes = own.groupBy("h11", "ks_id").agg(F.count("*").alias("n_frsts"))
        _numbered(polytopes, f"{root}/polytope_catalog/h11_{h}", 1, "ks_id")
        _numbered(polytopes.select("h11", "ks_id", F.array(F.col("ks_id")).alias("cy_basis")), f"{root}/polytope/h11_{h}", 1, "ks_id")
    return PhaseStore(spark, root)


@query("select cast(p_partkey // 100 as bigint) triang_id, cast(p_size as bigint) c2, cast(17 as bigint) basis from part where p_partkey % 100 = 17")
def stored_phases(spark, d):
    """All phases of a polytope with their tensors and its own data."""
    s = _phases(spark, d)
    place = ["shard_id", "h11_of_path", "file", "row_index"]
    phases = s.query("frst", 2, ks_id=17).drop(*place)
    out = J.phase_with_geometry(phases, s._dir("frst/geom", 2).drop(*place), s._dir("polytope", 2).drop(*place))
    return out.select("triang_id", F.get("c2", F.lit(0)).alias("c2"), F.get("cy_basis", F.lit(0)).alias("basis"))


@query("select cast(2 as bigint) h11, cast(p_partkey % 100 as bigint) ks_id, count(*) n_frsts, cast(p_partkey % 100 as bigint) basis from part where p_partkey % 5 = 2 group by p_partkey % 100")
def stored_polytopes(spark, d):
    """Polytopes of one h11: metadata with the geometry of the same one."""
    s = _phases(spark, d)
    meta = s.query_polytopes(2).select("h11", "ks_id", "n_frsts")
    return meta.join(s._dir("polytope", 2).select("h11", "ks_id", F.get("cy_basis", F.lit(0)).alias("basis")), ["h11", "ks_id"])


@query("""with p as (select p_partkey % 5 h11, count(*) n from part group by 1) select 'frst' "mode", cast(h11 as integer) h11, n from p union all select 'frst', null, sum(n)::bigint from p union all select null, null, sum(n)::bigint from p""")
def stored_phase_counts(spark, d):
    """Phases by mode and h11 with totals, from the store's files."""
    return _phases(spark, d).info().select("mode", "h11", "n")


# --- shards, runs, fragments --------------------------------------------------------


def _solutions(spark: SparkSession, d: str) -> DataFrame:
    """orders as solutions, a geometry for each segment of customers."""
    o = _t(spark, d, "orders")
    return o.select(
        F.array((F.col("o_custkey") % 50).cast("int"), (F.col("o_orderkey") % 97).cast("int")).alias("flux"), F.array(F.col("o_totalprice") / 1e5).alias("moduli_re"), F.array(F.lit(1.0)).alias("moduli_im"),
        (F.col("o_orderkey") % 7).cast("double").alias("tau_re"), F.lit(2.0).alias("tau_im"), F.concat(F.lit("run"), F.col("o_orderstatus")).alias("run_id"), F.concat(F.lit("geo"), F.col("o_custkey") % 3).alias("geometry_id"),
        F.lit(1).alias("tadpole_charge"), F.col("o_orderdate").alias("created_at"), F.lit(2).alias("h12"), (F.col("o_custkey") % 3 + 1).cast("int").alias("h11"), (F.col("o_custkey") % 3).cast("int").alias("ks_id"),
        F.lit(-1).alias("triang_id"), F.lit(-1).alias("conifold_id"), F.lit(-1).alias("cicy_id"), (F.col("o_orderkey") % 2 == 0).alias("is_susy"), F.col("o_orderkey").cast("long").alias("seed"),
    )


def _shards(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    root = _place(spark, "shards")
    SH.write_table(_solutions(spark, d), root)
    catalog, _ = SH.shard_catalog(spark, root)
    return catalog, root


@query("select o_orderkey seed, 'run' || o_orderstatus run_id, cast(o_custkey % 50 as integer) f0 from orders where o_custkey % 3 = 1 and o_orderkey % 2 = 0")
def shard_query(spark, d):
    """Rows of the shards of one geometry that keep supersymmetry."""
    catalog, _ = _shards(spark, d)
    return SH.query_shards(spark, catalog, geometry_id="geo1", is_susy=True).select("seed", "run_id", F.get("flux", F.lit(0)).alias("f0"))


@query("select 'run' || o_orderstatus run_id, 'geo' || o_custkey % 3 geometry_id, cast(o_custkey % 3 + 1 as integer) h11, count(*) n_rows from orders group by all")
def shard_catalog(spark, d):
    """Shards by run and geometry with their rows, from footers and first values."""
    catalog, _ = _shards(spark, d)
    return catalog.groupBy("run_id", "geometry_id", "h11").agg(F.sum("n_rows").alias("n_rows"))


@query("select 'run' || o_orderstatus run_id, count(*) n from orders group by 1")
def footer_counts(spark, d):
    """Rows of every run's files from their footers alone."""
    _, root = _shards(spark, d)
    foot = SH.footers(spark, list_files(spark, root, hidden=False)).where("error is null")
    return foot.groupBy(F.regexp_extract("path", "run_id=([^/]+)/", 1).alias("run_id")).agg(F.sum("n_rows").alias("n"))


def _session(spark: SparkSession, d: str) -> tuple[RUNS.SessionStore, DataFrame]:
    rows = _solutions(spark, d).select("flux", "moduli_re", "moduli_im", "tau_re", "tau_im", "is_susy", F.col("seed").alias("vacuum_id"), "ks_id")
    store = RUNS.SessionStore(spark, _place(spark, "sessions"))
    return store, store.write_models(rows, ["ks_id"], ["vacuum_id"], method="scan")


_FIRST = "f as (select o_custkey % 3 k, min(o_orderkey) vacuum_id, count(*) n from orders group by o_custkey % 3, o_custkey % 50, o_orderkey % 97)"


@query(f"with {_FIRST} select cast(k as integer) ks_id, count(*) n_written, cast(sum(n) - count(*) as bigint) n_skipped from f group by 1")
def session_write(spark, d):
    """Solutions of every model stored in one pass; repeated fluxes of a model are skipped."""
    return _session(spark, d)[1].select("ks_id", "n_written", "n_skipped")


@query(f"with {_FIRST} select vacuum_id from f where k <> 1")
def session_delete(spark, d):
    """What a store has after the runs of one model were deleted."""
    store, _ = _session(spark, d)
    store.delete(ks_id=1)
    return store.rows.select("vacuum_id")


@query(f"with {_FIRST} select vacuum_id, 'scan' \"method\" from f where k = 2")
def session_run(spark, d):
    """One model's run, loaded by its id, with the run's method; storing it once more adds nothing."""
    store, told = _session(spark, d)
    run = Q.lookup(told, ks_id=2)["run_id"]
    again = store.load(run).select("flux", "moduli_re", "moduli_im", "tau_re", "tau_im", "is_susy", "vacuum_id")
    with store.writer({"ks_id": 2}, method="again") as w:
        w.append_batch(again)
    return J.with_run_fields(store.rows.where(F.col("run_id").isin(run, w.run_id)), store.runs).select("vacuum_id", "method")


@query("select o_orderstatus stage_of, o_orderkey id from orders where o_orderstatus <> 'P'")
def stage_fragments(spark, d):
    """Rows of two stages' fragments, read back by glob over what is not given."""
    path = _place(spark, "fragments")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stage_of"))
    for stage in ("F", "O", "P"):
        RUNS.write_fragment(o.where(F.col("stage_of") == stage), path, stage, "main", "r1", {"ks_id": 1, "coni_class_id": 0, "coni_id": 2}, window=[1, 2])
    return RUNS.read_fragments(spark, path, "F").unionByName(RUNS.read_fragments(spark, path, "O", coni_id=2)).select("stage_of", "id")


@query("""with r as (select o_orderkey, o_custkey % 50 a, o_orderkey % 97 b, o_custkey % 3 k from orders where o_orderstatus = 'F')
 select row_number() over (order by o_orderkey) + 4 as designated_id, 'tag' || (o_orderkey % 3) tag, 'run1' source_run_id from r""")
def designated(spark, d):
    """All finished orders designated: contiguous ids above those in use, tags merged."""
    rows = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.array(F.col("o_orderkey").cast("int"), (F.col("o_custkey") % 50).cast("int")).alias("flux"), F.array(F.lit(1.0)).alias("moduli_re"), F.array(F.lit(1.0)).alias("moduli_im"), F.lit(0.5).alias("tau_re"), F.lit(2.0).alias("tau_im"), F.lit("run1").alias("run_id"), F.to_json(F.array(F.concat(F.lit("tag"), F.col("o_orderkey") % 3))).alias("tags"))
    known = spark.createDataFrame([(4, 9, [0, 0])], "designated_id long, ks_id int, flux array<int>")
    new, _ = V.designate(rows, known, {"ks_id": 9}, "run_v2", "me", "2024-01-01", ["o_orderkey"], tags=["all"])
    return new.select("designated_id", F.get(X.json_tags("tags"), F.lit(0)).alias("tag"), "source_run_id")


# --- similarity ---------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    day = F.dayofyear("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("model"), F.array(F.floor(F.col("o_totalprice") / 5000).cast("int"), F.floor(day / 10).cast("int"), (F.col("o_custkey") % 50).cast("int"), F.month("o_orderdate")).alias("flux"),
        F.array(F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 50) + 1.0).alias("moduli_re"), F.array(day / 100, F.lit(1.0)).alias("moduli_im"), (F.col("o_totalprice") / 1e5).alias("tau_re"), (day / 100).alias("tau_im"),
    )


_V = """v as (select o_orderkey id, o_orderstatus model, cast(floor(o_totalprice / 5000) as integer) f0, cast(floor(dayofyear(o_orderdate) / 10.0) as integer) f1, cast(o_custkey % 50 as integer) f2, cast(month(o_orderdate) as integer) f3,
 o_totalprice / 1e5 x, dayofyear(o_orderdate) / 100.0 y, o_custkey % 50 + 1.0::double z from orders), q as (select * from v where id % 50 = 0)"""


@query(f"""with {_V} select q.model, q.id a_id, v.id b_id, cast(greatest(abs(q.f0 - v.f0), abs(q.f1 - v.f1), abs(q.f2 - v.f2), abs(q.f3 - v.f3)) as double) distance
 from q join v using (model) where abs(q.f0 - v.f0) <= 2 and abs(q.f1 - v.f1) <= 2 and abs(q.f2 - v.f2) <= 2 and abs(q.f3 - v.f3) <= 2""")
def near_flux(spark, d):
    """Every fiftieth solution against all of its model, by the largest difference of the flux."""
    v = _vectors(spark, d)
    return SIM.near_flux(v.where("id % 50 = 0"), v, ["model"], 2)


@query(f"""with {_V} select q.model, q.id a_id, v.id b_id from q join v using (model)
 where sqrt((q.x - v.x) ** 2 + (q.y - v.y) ** 2) / sqrt(v.x ** 2 + v.y ** 2) <= 0.05 and sqrt((q.z - v.z) ** 2) / sqrt(v.z ** 2 + 1) <= 0.05""")
def near_moduli(spark, d):
    """The same by moduli, relative to the stored ones."""
    v = _vectors(spark, d)
    return SIM.near(v.where("id % 50 = 0"), v, ["model"], moduli_tol=0.05)


@query(f"""with {_V} select q.model, q.id a_id, v.id b_id from q join v using (model)
 where sqrt((q.x - v.x) ** 2 + (q.y - v.y) ** 2) / sqrt(v.x ** 2 + v.y ** 2) <= 0.02 and abs(q.f2 - v.f2) <= 3 and abs(q.f0 - v.f0) <= 3 and abs(q.f1 - v.f1) <= 3 and abs(q.f3 - v.f3) <= 3""")
def near_tau(spark, d):
    """By tau relative to the stored one, and the flux."""
    v = _vectors(spark, d)
    return SIM.near(v.where("id % 50 = 0"), v, ["model"], tau_tol=0.02, flux_tol=3)


@query("""with e as (select vec_id id, label, list_transform(embedding[1:4], lambda x: cast(floor(x * 8) as integer)) f from embeddings), c as (select label, f, min(id) class_id, count(*) n from e group by label, f)
 select e.label, e.id, c.class_id, c.n n_copies from e join c on e.label = c.label and e.f = c.f""")
def flux_classes(spark, d):
    """Vectors of a label that are equal when rounded, as classes with membership."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(x.cast("double") * 8).cast("int")).alias("flux"))
    first, member = SIM.classes(v, ["label"], ["flux"])
    return member.join(first.select(F.col("id").alias("class_id"), "n_copies"), "class_id").select("label", "id", "class_id", "n_copies")


# --- matrices and physics -----------------------------------------------------------

_E = "e as (select vec_id, embedding[1]::double a, embedding[2]::double b, embedding[3]::double c, embedding[4]::double d, embedding[5]::double g from embeddings)"


@query(f"""with {_E}, r as (select vec_id, (a + d) / 2 m, sqrt(((a - d) / 2) ** 2 + ((b + c) / 2) ** 2) s, sqrt(((a - d) / 2) ** 2 + ((b + c) / 2) ** 2 + g ** 2) h from e)
 select vec_id, round(m - s, 6) low, round(m + s, 6) high, round(m - h, 6) low_hermitian, round(m + h, 6) high_hermitian from r""")
def eigenvalues(spark, d):
    """Eigenvalues of 2 x 2 matrices, real and Hermitian, a batch in one call."""
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(5)]
    zero = F.lit(0.0)
    m = _t(spark, d, "embeddings").select("vec_id", F.array(F.array(e[0], e[1]), F.array(e[2], e[3])).alias("re"), F.array(F.array(zero, e[4]), F.array(-e[4], zero)).alias("im"))
    m = m.select("vec_id", MX.least_eigenvalue("re").alias("low"), F.get(MX.spectrum("re"), F.lit(1)).alias("high"), MX.least_hermitian("re", "im").alias("low_hermitian"), F.get(MX.hermitian_spectrum("re", "im"), F.lit(1)).alias("high_hermitian"))
    return m.select("vec_id", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


@query(f"""with {_E}, t as (select vec_id, a, d, g, sqrt(b * b + c * c) s from e)
 select vec_id, round(list_sort([a, d - s, d + s])[1], 6) least, round(list_sort([a, d - s, d + s])[2], 6) middle, round(list_sort([a, d - s, d + s])[3], 6) most from t""")
def eigenvalues_of_three(spark, d):
    """A Hermitian 3 x 3 matrix of a number and a block with a complex entry."""
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    z = F.lit(0.0)
    m = _t(spark, d, "embeddings").select("vec_id", F.array(F.array(e[0], z, z), F.array(z, e[3], e[1]), F.array(z, e[1], e[3])).alias("re"), F.array(F.array(z, z, z), F.array(z, z, e[2]), F.array(z, -e[2], z)).alias("im"))
    m = m.select("vec_id", MX.hermitian_spectrum("re", "im").alias("s"))
    return m.select("vec_id", *(F.round(F.get("s", F.lit(k)), 6).alias(n) for k, n in enumerate(("least", "middle", "most"))))


@query(f"""with {_E}, r as (select vec_id, a + 0.3 metric, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + ((b + c) / 2) ** 2) low, 1 + g * 2 im from e)
 select vec_id, metric > 1e-10 and low >= -1e-8 and im >= 1 passed from r""")
def endpoint_certificates(spark, d):
    """Endpoints certified from their matrices: a metric of one entry, a Hessian and masses of two by two."""
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(5)]
    one = lambda x: F.array(F.array(x))
    square = F.array(F.array(e[0], e[1]), F.array(e[2], e[3]))
    cert = MX.endpoint(one(e[0] + 0.3), one(F.lit(0.0)), square, square, 1 + e[4] * 2)
    return _t(spark, d, "embeddings").select("vec_id", cert["passed"].alias("passed"))


class _Plain:
    """Physics that SQL has too; functions of arrays of rows."""

    def tadpole(self, flux):
        return np.abs(flux).sum(axis=1)

    def superpotential(self, z, tau, flux):
        return flux[:, 0] * z[:, 0] + flux[:, 1] * tau

    def DW(self, z, tau, flux):
        return np.stack([z[:, 0] - z[:, 1], tau], axis=1)

    def kahler_potential(self, z, tau):
        return np.zeros(len(tau))

    def mass_matrix(self, z, tau, flux):
        return flux[:, :2, None] * np.eye(2)


@query(f"""with {_V} select id, cast(abs(f0) + abs(f1) + abs(f2) + abs(f3) as double) N_flux, round(f0 * x + f1 * x, 9) W_re, round(f0 * y + f1 * y, 9) W_im, round(1 / y, 9) g_s,
 cast(least(f0, f1) as double) low_mass, round(sqrt((f0 * x + f1 * x) ** 2 + (f0 * y + f1 * y) ** 2), 8) m_gravitino, greatest(sqrt((x - z) ** 2 + (y - 1) ** 2), sqrt(x ** 2 + y ** 2)) < 0.9 is_susy from v""")
def derived_columns(spark, d):
    """Derived columns of all solutions, 1,024 in one call of the model."""
    out = M.complete_missing(_vectors(spark, d).drop("model"), _Plain(), tol=0.9, batch=1024)
    return out.select("id", "N_flux", *(F.round(c, 9).alias(c) for c in ("W_re", "W_im", "g_s")), F.get("mass2", F.lit(0)).alias("low_mass"), F.round("m_gravitino", 8).alias("m_gravitino"), "is_susy")


# --- nested models, complete intersections ------------------------------------------


@query("select p_partkey ks_id, p_size h11, 51 - p_size h12 from part")
def complete_intersections(spark, d):
    """Rows that are stored mirrored, in the plain convention."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("ks_id"), F.col("p_size").alias("h12"), (F.lit(51) - F.col("p_size")).alias("h11"))
    return M.cicy_rows(p).select("ks_id", "h11", "h12")


@query("""with c as (select l_partkey k, count(*) n, min(l_suppkey) low from (select distinct l_partkey, l_suppkey from lineitem) group by 1)
 select p_partkey ks_id, p_retailprice price, coalesce(n, 0) n_conifolds, low first_conifold from part left join c on k = p_partkey""")
def nested_models(spark, d):
    """One nested row for each model: key, detail and conifolds in order."""
    p = _t(spark, d, "part")
    coni = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("ks_id"), F.col("l_suppkey").alias("conifold_id")).distinct()
    out = M.models(p.select(F.col("p_partkey").alias("ks_id")), p.select(F.col("p_partkey").alias("ks_id"), "p_retailprice"), ["ks_id"], conifolds=coni)
    return out.select("ks_id", F.col("detail.p_retailprice").alias("price"), F.when(F.col("conifolds").isNull(), 0).otherwise(F.size("conifolds")).cast("long").alias("n_conifolds"), F.get("conifolds", F.lit(0))["conifold_id"].alias("first_conifold"))


@query("select s_suppkey ks_id, s_nationkey n, s_suppkey % 5 k from supplier")
def phase_tensors(spark, d):
    """In-basis tensor entries and second Chern numbers of phases, through the accessors."""
    s = _t(spark, d, "supplier")
    long = lambda *x: F.array(*(F.lit(v).cast("long") if not hasattr(v, "cast") else v.cast("long") for v in x))
    df = s.select(F.col("s_suppkey").alias("ks_id"), long(0, 1).alias("intnums_coo_i"), long(0, 1).alias("intnums_coo_j"), long(0, 1).alias("intnums_coo_k"), F.array(F.col("s_nationkey").cast("long") * 0 + 9, F.col("s_nationkey").cast("long")).alias("intnums_coo_v"), F.array(F.lit(7).cast("long"), (F.col("s_suppkey") % 5).cast("long")).alias("c2"), long(1).alias("cy_basis"), F.lit(1).cast("long").alias("h11"))
    out = M.second_chern(M.full_tensors(df), True)
    return out.select("ks_id", F.get("kappa", F.lit(0))["v"].alias("n"), F.get("c2_out", F.lit(0)).alias("k"))


@query("select o_orderkey, round(o_totalprice / 1e5, 9) v from orders")
def decoded_cells(spark, d):
    """Lists that were stored as JSON, decoded."""
    o = _t(spark, d, "orders").select("o_orderkey", F.to_json(F.array(F.col("o_totalprice") / 1e5)).alias("cell"))
    return o.select("o_orderkey", F.round(F.get(F.from_json("cell", "array<double>"), F.lit(0)), 9).alias("v"))


@query("select o_custkey % 10 k, max(o_orderkey) + 1 next_id from orders group by 1")
def next_ids(spark, d):
    """One more than the largest id of every table of many, in one pass."""
    return G.next_ids(_t(spark, d, "orders").withColumn("k", F.col("o_custkey") % 10), ["k"], "o_orderkey")


@query("""with r as (select vec_id, label, list_transform(embedding[1:3], lambda x: cast(round_even(cast(x as double) * 8, 0) as integer)) f from embeddings)
 select q.vec_id, exists (select 1 from r where r.label = (q.label + 1) % 5 and r.f = q.f) "there" from r q""")
def flux_exists(spark, d):
    """Whether each vector's rounded flux is stored for the next label's model, for all in one join."""
    from moraine.functions import ids

    v = _t(spark, d, "embeddings").select("vec_id", "label", ids.canonical_flux(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 8)).alias("flux"))
    asked = v.select("vec_id", ((F.col("label") + 1) % 5).alias("label"), "flux")
    return J.exists_many(asked, v, ["label"]).select("vec_id", "there")

