"""Files of designated solutions: catalogue, validation, promotion, upload and fetch.

Work on many files is a table of paths; of a file only what is small comes to the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.errors import ValidationError
from moraine.functions import text as X
from moraine.operators.joins import identity_columns
from moraine.operators.sets import union_all
from moraine.operators.vetting import split_policy, validate_rows
from moraine.schemas import FILE_CATALOG, FLOOR_COLUMNS, PRODUCTION, conform
from moraine.sources.catalog import list_files
from moraine.sources.shards import footers
from moraine.sources.shared import kept

SCHEMA_VERSION = 1
IDENTITY = ("ks_id", "triang_id", "cicy_id")


def rebuild_catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row for each file under a root, rejected ones too: what path, metadata and content tell."""
    base = root.rstrip("/")
    paths = [p for p in list_files(spark, base) if not _reserved(p)]
    if not paths:
        return spark.createDataFrame([], FILE_CATALOG)
    foot = footers(spark, paths)
    sums = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("p"), F.sha2("content", 256).alias("checksum"))
    norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = foot.join(sums, foot["path"] == sums["p"])
    plain = re.sub("^file:/+", "/", base)
    both = both.withColumn("file_path", F.substr(norm(F.col("path")), F.lit(len(plain) + 2)))
    x = both.select("*", *identity_columns("file_path"))
    kv = lambda k: F.try_element_at("metadata", F.lit(k))
    guessed = X.guess_susy("basename")
    out = x.withColumns({
        "susy": F.coalesce(kv("susy"), guessed), "method": kv("method"), "nmax": kv("nmax"), "qualifiers": kv("qualifiers"),
        "classification_source": F.when(kv("susy").isNotNull(), "metadata").when(guessed.isNotNull(), "filename"),
        "committed_by": kv("committed_by"), "schema_version": kv("schema_version").try_cast("long"), "superseded_by": kv("superseded_by"),
        "retracted": F.coalesce(kv("retracted") == "true", F.lit(False)), "retraction_reason": kv("retraction_reason"), "retracted_at": kv("retracted_at"), "uploaded_at": kv("uploaded_at"),
    })
    return conform(out, FILE_CATALOG, keep_unknown=False).orderBy("file_path")


def _reserved(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name in X.RESERVED_NAMES or name.startswith(("_", "."))


def _name_errors(path: Column) -> list[tuple[Column, str]]:
    """What a path alone tells."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.parquet$", "")
    return [
        (name.isin(list(X.RESERVED_NAMES)) | F.substring(name, 1, 1).isin("_", "."), "reserved name"),
        (F.contains(path, F.lit("/community/")) & ~F.contains(stem, F.lit("_")), "a submission's name starts with its user"),
        (~F.rlike(stem, F.lit(X.LABEL_PATTERN)), "the label is no slug"),
    ]


def _by_schema(spark: SparkSession, files: DataFrame) -> list[DataFrame]:
    """Rows of files with their path, cast to the types of the floor columns; one frame for each schema that files have."""
    out = []
    for r in files.groupBy("columns", "types").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():  # a row for each schema
        wanted = [c for c in (*FLOOR_COLUMNS, *IDENTITY, "is_susy", "N_flux", "residual") if c in r["columns"]]
        df = spark.read.parquet(*r["paths"])
        types = {f.name: f.dataType for f in PRODUCTION.fields} | {"flux": T.ArrayType(T.DoubleType()), "N_flux": T.DoubleType()} | {k: T.LongType() for k in IDENTITY}
        # identity is asked of every file, the others only where they are
        held = [F.col(c).try_cast(types[c]).alias(c) if c in wanted else F.lit(None).cast(types[c]).alias(c) for c in (*wanted, *(k for k in IDENTITY if k not in wanted))]
        out.append(df.select(_plain_path(F.col("_metadata.file_path")).alias("_file"), *held))
    return out


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def validate_files(spark: SparkSession, paths: list[str], physics: str = "off", model=None, tadpole: float | None = None, tol: float = 1e-6) -> DataFrame:
    """path, n_rows, errors and passed of each file, from footers and one scan of all rows.

    Files of one schema are read together; a column that is of another type somewhere is cast,
    and what cannot be is null.  Physics: off, auto (warn) or explicit (needs a model).
    """
    foot = kept(footers(spark, paths))
    version = F.try_element_at("metadata", F.lit("schema_version"))
    missing = F.array_except(F.array(*map(F.lit, FLOOR_COLUMNS)), F.col("columns"))
    readable = F.col("error").isNull()
    told = foot.select(
        "path", "n_rows", readable.alias("readable"), (F.size(missing) == 0).alias("whole"), F.arrays_overlap("columns", F.array(*map(F.lit, IDENTITY))).alias("keyed"),
        F.array_compact(F.array(
            *(F.when(bad, message) for bad, message in _name_errors(F.col("path"))), F.when(~readable, "cannot be read"),
            F.when(readable & ~version.eqNullSafe(F.lit(str(SCHEMA_VERSION))), F.concat(F.lit("schema version "), F.coalesce(version, F.lit("None")))),
            F.when(readable & (F.size(missing) > 0), F.concat(F.lit("missing columns ['"), F.array_join(missing, "', '"), F.lit("']"))),
            F.when(readable & (F.size(missing) == 0) & F.lit(physics == "explicit" and model is None), "no model for the physics checks"),
        )).alias("told"),
    )
    parts = _by_schema(spark, foot.where(readable & (F.size(missing) == 0)))
    if not parts:
        return told.select("path", "n_rows", F.col("told").alias("errors"), (F.size("told") == 0).alias("passed"))
    checks = {"tadpole": tadpole if physics != "off" else None, "tol": tol if physics != "off" else None, "susy_only": True}
    report = kept(union_all(*(validate_rows(p, **checks).select("_file", *IDENTITY, "errors") for p in parts)))
    models = report.groupBy("_file").agg(F.count_distinct(F.struct(*IDENTITY)).alias("models"), F.max(F.greatest(*(F.coalesce(F.col(k), F.lit(-1)) for k in IDENTITY))).alias("top"))
    counted = report.select("_file", F.explode("errors").alias("e")).groupBy("_file", "e").agg(F.count("*").alias("n"))
    counted = counted.groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("e", F.concat(F.col("n").cast("string"), F.lit(" rows: "), "e").alias("said")))).alias("counted"))
    both = told.withColumn("_plain", _plain_path(F.col("path"))).join(models, F.col("_plain") == models["_file"], "left").drop("_file").join(counted, F.col("_plain") == counted["_file"], "left")
    scanned = F.col("readable") & F.col("whole")
    identity = F.when(scanned & F.col("keyed") & F.col("models").isNull(), "no rows").when(scanned & (F.col("models") > 1), "more than one model").when(scanned & (~F.col("keyed") | (F.col("top") < 0)), "no identity")
    of_rows = F.coalesce(F.transform("counted", lambda x: x["said"]), F.array().cast("array<string>"))
    errors = F.concat("told", F.array_compact(F.array(identity)), of_rows)
    return both.select("path", "n_rows", errors.alias("errors"), (F.size(errors) == 0).alias("passed"))


def change_report(report: DataFrame) -> tuple[dict, str, int]:
    """(JSON, Markdown, exit code) of the validation of a change."""
    rows = report.orderBy("path").collect()
    told = {"n_files": len(rows), "n_rows": sum(max(0, r["n_rows"]) for r in rows), "n_failed": sum(not r["passed"] for r in rows), "files": [{"path": r["path"], "errors": list(r["errors"])} for r in rows]}
    lines = ["| file | result |", "|-|-|", *(f"| {r['path']} | {'; '.join(r['errors']) or 'ok'} |" for r in rows)]
    return told, "\n".join(lines), int(told["n_failed"] > 0)


def curate(root: str | Path, submission: str) -> Path:
    """Move a submission out of ``community``, without its user, under a name that is free."""
    source = Path(root) / submission
    if source.parent.name != "community":
        raise ValueError("only files of a community folder are promoted")
    target = source.parent.parent
    label = re.sub(r"\.parquet$", "", source.name).partition("_")[2] or source.stem
    name = X.free_version(re.sub(r"_v\d+$", "", label), [p.name for p in target.glob("*.parquet")], "new_version")
    source.rename(target / name)
    return target / name


def push(df: DataFrame, root: str | Path, model_dir: str, label: str, author: str, policy: str = "error", strict: bool = True, known: DataFrame | None = None, **checks) -> dict:
    """Write validated rows as one file of a model's folder, rejected rows beside it in ``_rejected``.

    Strict: any failing row is an error.
    """
    if not re.fullmatch(X.LABEL_PATTERN[1:-1], label):
        raise ValidationError("the label is no slug")
    if not author:
        raise ValidationError("an author is needed")
    good, bad = split_policy(validate_rows(df, known, **checks), strict)
    folder = Path(root) / model_dir
    name = X.free_version(label, [p.name for p in folder.glob("*.parquet")], policy)
    out = {"file": str(folder / name), "n_rows": good.count(), "n_rejected": bad.count()}
    for part, path, n in ((good, folder / name, out["n_rows"]), (bad, folder / "_rejected" / name, out["n_rejected"])):
        if n:
            if part is good and path.exists():  # append
                part = good.sparkSession.read.parquet(str(path)).unionByName(good, allowMissingColumns=True)
            temp = folder / f".{uuid.uuid4().hex}"
            part.coalesce(1).write.parquet(str(temp))  # a label is one file by contract
            path.parent.mkdir(parents=True, exist_ok=True)
            next(temp.glob("part-*.parquet")).replace(path)
            for f in temp.iterdir():
                f.unlink()
            temp.rmdir()
    return out


def fetch(spark: SparkSession, root: str, model_dir: str, label: str | None = None, community: bool = False) -> DataFrame:
    """Rows of a model's files with where they come from; rejected files never, submissions on request, retracted rows hidden."""
    paths = []
    for p in list_files(spark, f"{root.rstrip('/')}/{model_dir}"):
        name = p.rpartition("/")[2]
        if "/_rejected/" in p or _reserved(p) or ("/community/" in p and not community):
            continue
        if label is not None and not re.fullmatch(rf"{re.escape(label)}(_v\d+)?\.parquet", name):
            continue
        paths.append(p)
    if not paths:
        raise FileNotFoundError(f"nothing for {model_dir}")
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    df = df.select("*", F.col("_metadata.file_path").alias("_source_path"))
    return df.where(~F.coalesce(F.col("retracted"), F.lit(False))) if "retracted" in df.columns else df


def browse(catalog: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """The file catalogue without retracted files, by exact filters."""
    from moraine.operators.filters import exact, first_rows, where_all

    out = where_all(catalog, [~F.coalesce(F.col("retracted"), F.lit(False)), *exact(catalog, filters)])
    return out if limit is None else first_rows(out, limit, ["file_path"])


def clear_cache(folder: str | Path, keep: Iterable[str] = (), offline: bool = False) -> int:
    """Remove what is cached, but for some sub-folders; bytes freed.  Never while offline."""
    if offline:
        raise RuntimeError("a cache is not cleared while offline")
    freed, keep = 0, set(keep)
    for p in sorted(Path(folder).rglob("*"), reverse=True):
        if p.relative_to(folder).parts[0] in keep:
            continue
        if p.is_file():
            freed += p.stat().st_size
            p.unlink()
        elif not any(p.iterdir()):
            p.rmdir()
    return freed


def cache_size(folder: str | Path, warn_bytes: int = 500 * 1024 * 1024, warn: Callable[[str], None] | None = None) -> int:
    n = sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
    if n > warn_bytes and warn:
        warn(f"the cache holds {n} bytes")
    return n


def sha256(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def export_splits(df: DataFrame, to: str, key: str = "geometry_id") -> dict[str, str]:
    """One Parquet folder for each split, to load elsewhere."""
    from moraine.functions.ids import DEFAULT_SPLITS
    from moraine.operators.filters import split_view

    out = {}
    for name, _ in DEFAULT_SPLITS:
        out[name] = f"{to}/{name}"
        split_view(df, name, key).write.mode("overwrite").parquet(out[name])
    return out


def to_pandas(df: DataFrame, most: int) -> pd.DataFrame:
    """A bounded number of rows for the driver."""
    return df.limit(most).toPandas()


def dump(told: dict) -> str:
    return json.dumps(told, sort_keys=True)
