"""Filters, projections and lookups over catalogues (every stored table is one)."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from moraine.functions import arrays as A
from moraine.functions import ids
from moraine.functions import text as X


def where_all(df: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    """One filter of all conditions, so that those on stored columns reach the scan."""
    conditions = list(conditions)
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def present(df: DataFrame, **ranges: tuple[str, str, object]) -> list[Column]:
    """Conditions name=(column, how, value); those with no value, or on a column the table lacks, fall away."""
    out = []
    for column, how, value in ranges.values():
        if value is None or column not in df.columns:
            continue
        c = F.col(column)
        out.append({"=": lambda: c == value, "<=": lambda: c <= value, ">=": lambda: c >= value, ">": lambda: c > value, "in": lambda: c.isin(list(value))}[how]())
    return out


def exact(df: DataFrame, filters: Mapping[str, object]) -> list[Column]:
    """Equalities on further columns; a column the table lacks is told and ignored."""
    out = []
    for name, value in filters.items():
        if name not in df.columns:
            warnings.warn(f"no column {name!r}; this filter is ignored", stacklevel=3)
        elif value is not None:
            out.append(F.col(name) == value)
    return out


def query_catalog(df: DataFrame, h11=None, h12=None, has_conifolds: bool | None = None, min_conifolds=None, max_conifolds=None, has_gv: bool | None = None, max_tadpole=None, **more) -> DataFrame:
    """Rows of a geometry catalogue.

    ``has_conifolds=False`` means none, not no filter; a filter on a column the table lacks is
    no filter.
    """
    c = present(df, a=("h11", "=", h11), b=("h12", "=", h12), d=("n_conifolds", ">=", min_conifolds), e=("n_conifolds", "<=", max_conifolds), f=("has_gv", "=", has_gv), g=("D3_tadpole", "<=", max_tadpole))
    if has_conifolds is not None and "n_conifolds" in df.columns:
        c.append(F.col("n_conifolds") > 0 if has_conifolds else F.col("n_conifolds") == 0)
    return where_all(df, c + exact(df, more))


def query_conifolds(df: DataFrame, h11=None, h12=None, ncf=None, conifold_id=None, **more) -> DataFrame:
    c = present(df, a=("h11", "=", h11), b=("h12", "=", h12), d=("ncf", "=", ncf), e=("conifold_id", "=", conifold_id))
    return where_all(df, c + exact(df, more))


def swap(df: DataFrame, a: str = "h11", b: str = "h12") -> DataFrame:
    """Two columns exchange their names."""
    if a not in df.columns or b not in df.columns:
        return df.withColumnsRenamed({a: b} if a in df.columns else {b: a} if b in df.columns else {})
    return df.select(*(F.col(b if x == a else a if x == b else x).alias(x) for x in df.columns))


def mirror_query(df: DataFrame, h11=None, h12=None, mirrored: bool = True, **filters) -> DataFrame:
    """A catalogue query in the mirror convention, on the way in and out; chi goes.

    Catalogues that are stored mirrored already are queried as they are.
    """
    if not mirrored:
        return query_catalog(df, h11=h11, h12=h12, **filters)
    return swap(query_catalog(df, h11=h12, h12=h11, **filters)).drop("chi")


def mirror_query_conifolds(df: DataFrame, h11=None, h12=None, mirrored: bool = True, **filters) -> DataFrame:
    if not mirrored:
        return query_conifolds(df, h11=h11, h12=h12, **filters)
    return swap(query_conifolds(df, h11=h12, h12=h11, **filters)).drop("chi")


def tag_filter(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), mode: str = "all", column: str = "tags", as_json: bool = False) -> DataFrame:
    """Rows that have all (or any) of some tags and none of others.

    Where the table has no tags, asking for a tag gives no rows and excluding one is ignored.
    """
    include, exclude = ([x] if isinstance(x, str) else list(x) for x in (include, exclude))
    if column not in df.columns:
        return df.where(F.lit(False)) if include else df
    tags = F.col(column) if dict(df.dtypes)[column].startswith("array") else X.json_tags(column) if as_json else X.tags_of(column)
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    has = {"all": X.has_all_tags, "any": X.has_any_tag}[mode]
    return where_all(df, [f for f, on in ((has(tags, include), include), (X.has_no_tag(tags, exclude), exclude)) if on])


def query_polytopes(df: DataFrame, h11=None, h12=None, min_q=None, max_q=None, min_rigids=None, min_classes=None, max_classes=None, include_tags=(), exclude_tags=(), tag_mode="all", **more) -> DataFrame:
    """Polytopes of the curated index, in the mirror convention."""
    c = present(df, a=("h11", "=", h12), b=("h12", "=", h11), d=("Q", ">=", min_q), e=("Q", "<=", max_q), f=("n_rigids_dual", ">=", min_rigids), g=("n_coni_classes", ">=", min_classes), h=("n_coni_classes", "<=", max_classes))
    return swap(tag_filter(where_all(df, c + exact(df, more)), include_tags, exclude_tags, tag_mode)).drop("chi")


def query_classes(df: DataFrame, h11=None, h12=None, ks_id=None, coni_class_id=None, min_conifolds=None, max_conifolds=None, include_tags=(), exclude_tags=(), tag_mode="all", **more) -> DataFrame:
    c = present(df, a=("h11", "=", h12), b=("h12", "=", h11), d=("ks_id", "=", ks_id), e=("coni_class_id", "=", coni_class_id), f=("n_conifolds_in_class", ">=", min_conifolds), g=("n_conifolds_in_class", "<=", max_conifolds))
    return swap(tag_filter(where_all(df, c + exact(df, more)), include_tags, exclude_tags, tag_mode)).drop("chi")


def query_index(df: DataFrame, h11=None, h12=None, ks_id=None, coni_class_id=None, coni_id=None, tdf_status=None, include_tags=(), exclude_tags=(), tag_mode="all", **more) -> DataFrame:
    c = present(df, a=("h11", "=", h12), b=("h12", "=", h11), d=("ks_id", "=", ks_id), e=("coni_class_id", "=", coni_class_id), f=("coni_id", "=", coni_id), g=("tdf_status", "=", tdf_status))
    return swap(tag_filter(where_all(df, c + exact(df, more)), include_tags, exclude_tags, tag_mode)).drop("chi")


def query_phases(df: DataFrame, mode: str, h11: int, ks_id=None, triang_id=None, h12=None, fav_n=None, fav_m=None, trilayer=None) -> DataFrame:
    """Phases of one mode and h11, with phase_id and the digest as text.  All filters hold together."""
    c = present(df, z=("mode", "=", mode), a=("h11", "=", h11), b=("ks_id", "=", ks_id), d=("triang_id", "=", triang_id), e=("h12", "=", h12), f=("fav_N", "=", fav_n), g=("fav_M", "=", fav_m), h=("trilayer", "=", trilayer))
    out = where_all(df, c).withColumn("phase_id", ids.phase_id(F.lit(mode), "h11", "ks_id", "triang_id"))
    return out.withColumn("wall_hash_hex", ids.hex_digest("wall_hash")) if "wall_hash" in df.columns else out


def query_toric_polytopes(df: DataFrame, h11: int, vex_counts: DataFrame | None = None, ks_id=None, h12=None, fav_n=None, fav_m=None, trilayer=None) -> DataFrame:
    c = present(df, a=("h11", "=", h11), b=("ks_id", "=", ks_id), e=("h12", "=", h12), f=("fav_N", "=", fav_n), g=("fav_M", "=", fav_m), h=("trilayer", "=", trilayer))
    out = where_all(df, c)
    return out if vex_counts is None else join_counts(out, vex_counts, "ks_id")


def join_counts(df: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Counts of each row's key, null where there are none."""
    own = [c for c in counts.columns if c == key or c not in df.columns]
    return df.join(counts.select(*own), key, "left")


def query_solutions(rows: DataFrame, is_susy: bool | None = None, max_flux: float | None = None, tags: Sequence[str] | str = (), limit: int | None = None, order: Sequence[str] = (), hide_retracted: bool = False, **equal) -> DataFrame:
    """Rows by their own columns: SUSY, flux number (null never passes), all tags, a first few by an order."""
    c = exact(rows, {k: v for k, v in equal.items() if v is not None})
    if is_susy is not None and "is_susy" in rows.columns:
        c.append(F.col("is_susy") == is_susy)
    if max_flux is not None and "N_flux" in rows.columns:
        c.append(F.col("N_flux").isNotNull() & (F.col("N_flux") <= max_flux))
    if hide_retracted and "retracted" in rows.columns:
        c.append(~F.coalesce(F.col("retracted"), F.lit(False)))
    out = tag_filter(where_all(rows, c), tags, as_json=True) if tags else where_all(rows, c)
    return out if limit is None else first_rows(out, limit, order)


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows of an order; with none given, of all columns that can be ordered."""
    keys = list(order) or [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return df.orderBy(*keys).limit(n)


def query_runs(catalog: DataFrame, rows: DataFrame, is_susy=None, max_flux=None, tags=(), limit=None, **run_filters) -> DataFrame:
    """Rows of the runs that pass the run filters; run columns come along where rows lack them."""
    runs = where_all(catalog, exact(catalog, run_filters))
    own = [c for c in runs.columns if c == "run_id" or (c not in rows.columns and c not in ("n_vacua", "file_path"))]
    return query_solutions(rows.join(runs.select(*own), "run_id"), is_susy, max_flux, tags, limit)


def lookup(df: DataFrame, **key) -> Row:
    """The one row of a key: none is a KeyError, several a ValueError that tells them apart by h11 and h12."""
    found = where_all(df, [F.col(k) == v for k, v in key.items() if v is not None]).limit(2).collect()
    if not found:
        raise KeyError(f"no row for {key}")
    if len(found) > 1:
        tell = [tuple(r[c] for c in ("h11", "h12") if c in df.columns) for r in found]
        raise ValueError(f"several rows for {key}, such as {tell}; give more of the key")
    return found[0]


def check_key(key: Mapping[str, object], *needed: str) -> None:
    """All of a key must be given and be whole numbers."""
    for name in needed:
        value = key.get(name)
        if value is None:
            raise ValueError(f"{name} is needed")
        if not isinstance(value, int) or isinstance(value, bool):
            raise TypeError(f"{name} must be a whole number")


def identifiers(spark, items, columns: Sequence[str] = ("ks_id", "triang_id")) -> DataFrame:
    """Keys as a table: a table, numbers, or tuples with as many parts as columns (or h11, h12 and these)."""
    if isinstance(items, DataFrame):
        return items.select(*(c for c in ("h11", "h12", *columns) if c in items.columns)).distinct()
    rows = [(x,) if isinstance(x, int) else tuple(x) for x in items]
    widths = {len(r) for r in rows}
    if len(widths) > 1:
        raise ValueError("keys must all have as many parts")
    width = widths.pop() if widths else len(columns)
    names = list(columns)[:width] if width <= len(columns) else ["h11", "h12", *columns][:width]
    if width not in (len(names),):
        raise ValueError(f"keys have {width} parts; expected {len(columns)} or {len(columns) + 2}")
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))


def sample(df: DataFrame, n: int, seed: int, key: Sequence[str], strict: bool = True) -> DataFrame:
    """n rows without replacement, the same for the same seed: the least hashes of key and seed.

    With ``strict`` asking for more rows than there are is an error; else all come, and it is
    an error if there are none.
    """
    if strict and (have := df.limit(n).count()) < n:
        raise ValueError(f"asked for {n} of {have} rows")
    if not strict and df.isEmpty():
        raise ValueError("nothing to sample from")
    return df.withColumn("_u", ids.sampling_key(F.concat_ws("|", *key), seed)).orderBy("_u", *key).limit(n).drop("_u")


def split_view(df: DataFrame, split: str, key: str = "geometry_id", splits=ids.DEFAULT_SPLITS) -> DataFrame:
    """Rows whose key falls in a split."""
    if split not in dict(splits):
        raise ValueError(f"no split {split!r}; there are {[s for s, _ in splits]}")
    return df.where(ids.assign_split(key, splits) == split)


def features(df: DataFrame, columns: Sequence[str] | None = None, pad_to: Mapping[str, int] | None = None, fill: float = -1, keep_geometry_id: bool = True) -> DataFrame:
    """Columns for learning: by default all but keys, run and time; lists padded or cut to a length."""
    hidden = {"h11", "h12", "ks_id", "triang_id", "conifold_id", "cicy_id", "run_id", "created_at"}
    names = list(columns) if columns is not None else [c for c in df.columns if c not in hidden]
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"no columns {missing}")
    if keep_geometry_id and "geometry_id" in df.columns and "geometry_id" not in names:
        names.append("geometry_id")
    if not keep_geometry_id:
        names = [c for c in names if c != "geometry_id"]
    pad_to = pad_to or {}
    return df.select(*(A.pad(c, pad_to[c], fill).alias(c) if c in pad_to else F.col(c) for c in names))


def strip_untrusted(df: DataFrame) -> DataFrame:
    from moraine.schemas import UNTRUSTED_COLUMNS

    return df.drop(*UNTRUSTED_COLUMNS)


def read_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The asked columns that are there."""
    return df.select(*(c for c in columns if c in df.columns))
