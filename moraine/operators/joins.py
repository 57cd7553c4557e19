"""Joins: pointers, side tables, links, identity and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions import arrays as A


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Marked for broadcast if it is counted and has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def pointer_join(catalog: DataFrame, shards: DataFrame, shard: str, row: str, how: str = "inner", shard_key: str = "shard_id", row_key: str = "row_index") -> DataFrame:
    """Rows of a catalogue with the shard rows they point to; ``left`` keeps null pointers."""
    taken = set(catalog.columns)
    side = shards.select(F.col(shard_key).alias("_s"), F.col(row_key).alias("_r"), *(c for c in shards.columns if c not in taken | {shard_key, row_key}))
    return catalog.join(side, (F.col(shard) == F.col("_s")) & (F.col(row) == F.col("_r")), how).drop("_s", "_r")


def join_conifolds(catalog: DataFrame, conifolds: DataFrame, keys: Sequence[str], conifold_id: int | str = 0) -> DataFrame:
    """Geometries with one of their conifolds, or with ``"all"``, one row for each."""
    side = conifolds if conifold_id == "all" else conifolds.where(F.col("conifold_id") == conifold_id)
    return catalog.join(side.select(*keys, *(c for c in side.columns if c not in catalog.columns)), list(keys)).orderBy(*keys, "conifold_id")


def nested_conifolds(conifolds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All conifolds of a geometry as one list, by id."""
    inner = F.struct("conifold_id", *(c for c in conifolds.columns if c not in {*keys, "conifold_id"}))
    return conifolds.groupBy(*keys).agg(F.array_sort(F.collect_list(inner)).alias("conifolds"))


def optional(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Side data where there is any."""
    return df.join(side.select(*keys, *(c for c in side.columns if c not in df.columns)), list(keys), "left")


def curated_first(df: DataFrame, curated: DataFrame, plain: DataFrame, keys: Sequence[str], columns: Sequence[str], source: str | None = None) -> DataFrame:
    """Side data from the curated table where it has the key, else from the plain one; gv_source tells which."""
    c = curated.select(*keys, F.struct(*columns).alias("_c"))
    p = plain.select(*keys, F.struct(*columns).alias("_p"))
    both = df.join(c, list(keys), "left").join(p, list(keys), "left")
    picked = {"curated": F.col("_c"), "plain": F.col("_p")}.get(source or "", F.coalesce("_c", "_p"))
    told = F.lit(source) if source else F.when(F.col("_c").isNotNull(), "curated").when(F.col("_p").isNotNull(), "plain")
    return both.select(*df.columns, *(picked[x].alias(x) for x in columns), told.alias("gv_source"))


def phase_with_geometry(phases: DataFrame, geometry: DataFrame, polytopes: DataFrame, keys=("h11", "ks_id", "triang_id")) -> DataFrame:
    """Phases with their tensors and their polytope's data."""
    g = geometry.select(*keys, *(c for c in geometry.columns if c not in phases.columns))
    both = phases.join(g, list(keys))
    p = polytopes.select("h11", "ks_id", *(c for c in polytopes.columns if c not in both.columns))
    return both.join(p, ["h11", "ks_id"])


def link_status(index: DataFrame, catalog: DataFrame, keys: Sequence[str], status: str = "tdf_status") -> DataFrame:
    """The index with ``ok`` or ``orphaned`` for whether the catalogue has the key; the catalogue's repeats count once."""
    known = catalog.select(*keys).distinct().withColumn("_there", F.lit(True))
    out = index.join(known, list(keys), "left").withColumn(status, F.when(F.col("_there").isNull(), "orphaned").otherwise("ok"))
    return out.drop("_there")


def orphans(index: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    return index.join(catalog.select(*keys).distinct(), list(keys), "left_anti")


def refresh(index: DataFrame, catalog: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the index with columns copied anew from the catalogue, one row for each value that changed)."""
    source = catalog.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns)).dropDuplicates(list(keys))
    both = index.join(source.withColumn("_there", F.lit(True)), list(keys), "left")
    differ = lambda c: F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    changes = F.filter(F.array(*(F.when(differ(c), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), F.col(f"_new_{c}").cast("string").alias("new"))) for c in columns)), lambda x: x.isNotNull())
    log = both.select(*keys, F.explode(changes).alias("x")).select(*keys, "x.*")
    return both.select(*(F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in index.columns)), log


def exists(rows: DataFrame, flux: Sequence[int], column: str = "flux", **identity) -> bool:
    """Whether a solution with this flux is stored for a model."""
    wanted = F.array(*(F.lit(int(x)) for x in flux)).cast("array<int>")
    found = rows.where(F.col(column).cast("array<int>") == wanted)
    for k, v in identity.items():
        found = found.where(F.col(k) == v)
    return not found.limit(1).isEmpty()


def exists_many(asked: DataFrame, rows: DataFrame, model: Sequence[str], column: str = "flux", name: str = "there") -> DataFrame:
    """The asked rows with whether their model has their flux, all of them in one join."""
    whole = lambda df: F.transform(df[column], lambda x: x.cast("int"))
    known = rows.select(*model, whole(rows).alias("_flux")).distinct().withColumn("_there", F.lit(True))
    out = asked.withColumn("_flux", whole(asked)).join(known, [*model, "_flux"], "left")
    return out.select(*asked.columns, F.col("_there").isNotNull().alias(name))


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not known (also set difference)."""
    return df.join(known.select(*on).distinct(), list(on), "left_anti")


def similar_to(rows: DataFrame, flux=None, moduli=None, tau: complex | None = None, flux_tol: float = 0, moduli_tol: float = 1e-6, tau_tol: float = 1e-6) -> DataFrame:
    """Stored solutions near a given one: flux by its largest difference, moduli and tau relative to the stored ones.

    Empty lists, and lists of other lengths, are near nothing.
    """
    out = rows
    if flux is not None:
        out = out.where(A.linf("flux", F.array(*(F.lit(float(x)) for x in flux))) <= flux_tol)
    if moduli is not None:
        re, im = (F.array(*(F.lit(float(x)) for x in part)) for part in ([m.real for m in moduli], [m.imag for m in moduli]))
        out = out.where(A.relative_linf("moduli_re", "moduli_im", re, im) <= moduli_tol)
    if tau is not None:
        size = F.hypot("tau_re", "tau_im")
        out = out.where(F.hypot(F.col("tau_re") - tau.real, F.col("tau_im") - tau.imag) / F.when(size == 0, 1.0).otherwise(size) <= tau_tol)
    return out


def similarity_join(a: DataFrame, b: DataFrame, model: Sequence[str], vector: str = "flux", tol: float = 0.5, id_col: str = "id") -> DataFrame:
    """Pairs (a_id, b_id, distance) of one model whose vectors differ by ``tol`` at most in every entry.

    By the index of ``similarity``, over the whole vectors.  Of a table with itself both directions
    and each row with itself come, as for two tables.
    """
    from moraine.operators.similarity import near_flux

    return near_flux(a, b, model, tol, vector, id_col)


def with_run_fields(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Run columns for rows that lack them."""
    own = [c for c in runs.columns if c == "run_id" or (c not in rows.columns and c not in ("n_vacua", "file_path"))]
    return rows.join(runs.select(*own), "run_id")


def identity_columns(path: Column | str) -> list[Column]:
    """Identity of a stored file, from its path."""
    from moraine.functions.text import parse_path

    x = parse_path(path)
    return [x[c].alias(c) for c in ("namespace", "basename", "status", "h12", "ks_id", "triang_id", "cicy_id", "model_ID", "label", "version")]
