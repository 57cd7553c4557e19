"""Summaries, histograms, fingerprints and tensors in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalog_info(df: DataFrame) -> DataFrame:
    """One row: counts, ranges of h11 and h12, and shares of rows with invariants and with conifolds."""
    n = F.count("*")
    out = [n.alias("n_models")]
    for c in ("h11", "h12"):
        if c in df.columns:
            out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for name, test in (("has_gv", F.col("has_gv") if "has_gv" in df.columns else None), ("has_conifolds", F.col("n_conifolds") > 0 if "n_conifolds" in df.columns else None)):
        if test is not None:
            out += [F.count_if(test).alias(f"n_{name}"), (100.0 * F.count_if(test) / F.nullif(n, F.lit(0))).alias(f"pct_{name}")]
    return df.agg(*out)


def counts_with_total(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for each key, for each start of the key, and in all; ``level`` is 0 for the finest."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id(*keys).alias("level"))


def index_info(polytopes: DataFrame, classes: DataFrame, conifolds: DataFrame) -> DataFrame:
    """One row of counts over the three levels of the curated index."""
    p = polytopes.agg(F.count("*").alias("n_polytopes"), F.min("h11").alias("min_h11"), F.max("h11").alias("max_h11"))
    c = classes.agg(F.count("*").alias("n_classes"))
    orphaned = F.count_if(F.col("tdf_status") == "orphaned") if "tdf_status" in conifolds.columns else F.lit(0).cast("long")
    k = conifolds.agg(F.count("*").alias("n_conifolds"), orphaned.alias("n_orphaned"))
    return p.select("*", c.select("n_classes").scalar().alias("n_classes"), k.select("n_conifolds").scalar().alias("n_conifolds"), k.select("n_orphaned").scalar().alias("n_orphaned"))


def runs_info(catalog: DataFrame, model: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one row of totals with a map of methods, one row for each model)."""
    total = catalog.agg(F.coalesce(F.sum("n_vacua"), F.lit(0)).alias("n_vacua"), F.count("*").alias("n_runs"), F.count_distinct(F.struct(*model)).alias("n_models"))
    methods = catalog.groupBy(F.coalesce("method", F.lit("unknown")).alias("method")).count()
    as_map = methods.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "count")))).alias("methods"))
    return total.select("*", as_map.scalar().alias("methods")), catalog.groupBy(*model).agg(F.sum("n_vacua").alias("n_vacua"), F.count("*").alias("n_runs"))


def designated_info(designated: DataFrame, model: Sequence[str]) -> DataFrame:
    """One row: active solutions, their models and authors, and a map of labels."""
    active = designated.where(~F.coalesce(F.col("retracted"), F.lit(False)))
    labels = active.groupBy(F.coalesce("label", F.lit("unlabelled")).alias("label")).count()
    as_map = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("labels"))
    return active.agg(F.count("*").alias("n_active"), F.count_distinct(F.struct(*model)).alias("n_models"), F.count_distinct("committed_by").alias("n_authors")).select("*", as_map.scalar().alias("labels"))


def write_report(rows: DataFrame, model: Sequence[str]) -> DataFrame:
    return rows.groupBy(*model).agg(F.count("*").alias("n_written"))


def histogram(df: DataFrame, key: str, missing: str = "unverified", name: str | None = None) -> DataFrame:
    """Rows for each value, null counted under a name of its own."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(missing)).alias(name or key)).agg(F.count("*").alias("n"))


def manifest(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: shards, records, records by Hodge numbers, verifier and status, and certified records without evidence."""
    from moraine.functions.text import metric_passed

    def counted(key: Column) -> Column:
        return rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m")).scalar()

    lack = {"verifier_id", "cert_status", "cert_checks", "kahler_metric_min_eig"} - set(rows.columns)
    rows = rows.withColumns({c: F.lit(None).cast("double" if c.endswith("eig") else "string") for c in lack}) if lack else rows
    bad = (F.col("cert_status") == "certified") & ~metric_passed("cert_checks", "kahler_metric_min_eig")
    out = rows.agg(F.count("*").alias("n_records"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_without_evidence"))
    return out.select(
        shards.agg(F.count("*").alias("n")).scalar().alias("n_shards"), "n_records",
        counted(F.concat(F.lit("h11="), F.coalesce(F.col("h11"), F.lit(-1)).cast("string"), F.lit(",h12="), F.coalesce(F.col("h12"), F.lit(-1)).cast("string"))).alias("by_hodge"),
        counted(F.coalesce("verifier_id", F.lit("unverified"))).alias("by_verifier"), counted(F.coalesce("cert_status", F.lit("unverified"))).alias("by_status"), "n_without_evidence",
    )


def content_fingerprint(catalog: DataFrame, *columns: str) -> DataFrame:
    """One hash of a small catalogue's rows (one for each file), in their order."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    return catalog.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("content_sha256"))


def key_fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """A hash of a table's keys of any size, whatever their order: parts combine by addition and exclusive or."""
    h = F.xxhash64(*keys)
    g = F.xxhash64(F.lit("other"), *keys)
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(g), F.lit(0)).cast("string"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).cast("string")), 256).alias("fingerprint"))


def canonical_long(entries: DataFrame, group: Sequence[str], i: str = "i", j: str = "j", k: str = "k", v: str = "v") -> DataFrame:
    """Tensor entries in long form: indices of each in order, equal ones summed, zeros dropped."""
    low, high = F.least(i, j, k), F.greatest(i, j, k)
    keyed = entries.select(*group, low.alias("i"), (F.col(i) + F.col(j) + F.col(k) - low - high).alias("j"), high.alias("k"), F.col(v).alias("v"))
    return keyed.groupBy(*group, "i", "j", "k").agg(F.sum("v").alias("v")).where("v <> 0")


def distinct_identities(df: DataFrame, file: str, keys: Sequence[str]) -> DataFrame:
    """Files with more than one identity."""
    return df.groupBy(file).agg(F.count_distinct(F.struct(*keys)).alias("n_identities")).where("n_identities <> 1")


def next_id(df: DataFrame, key: str) -> int:
    """One more than the largest; 0 for an empty table."""
    top = df.agg(F.max(key)).first()[0]
    return 0 if top is None else int(top) + 1


def next_ids(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """One more than the largest id of each key, for all keys in one pass."""
    return df.groupBy(*keys).agg((F.max(id_col) + 1).alias("next_id"))


def split_summary(df: DataFrame, key: str, split: Column) -> DataFrame:
    """Rows and different keys of each split; the split is worked out once for each key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.withColumn("split", split).groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
