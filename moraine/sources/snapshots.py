"""Snapshots as manifests: what files a table had, with their sizes, rows and hashes; no row is copied.

A snapshot is a table of its files and a ``manifest.json`` that exactly one writer can create: it is
there once that file is.  Reading one reads the listed files, whatever was written since.  What a
snapshot lists must not be deleted: ``unreferenced`` tells what may.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.errors import ValidationError
from moraine.sources.rowgroups import open_file
from moraine.sources.shared import file_system, names_in, put_if_absent, read_bytes

FILES = "path string, n_rows long, bytes long, sha256 string"
_PIECE = 1 << 20


def described(spark: SparkSession, paths: Sequence[str], hashes: bool = True) -> DataFrame:
    """path, n_rows, bytes and sha256 of Parquet files, read in tasks, a piece of a file at a time."""
    import hashlib

    import pandas as pd
    import pyarrow.parquet as pq

    def one(path: str) -> tuple:
        rows = pq.ParquetFile(open_file(path)).metadata.num_rows
        digest, size, source = hashlib.sha256(), 0, open_file(path)
        if not hashes:
            return path, rows, source.size(), None
        while piece := source.read(_PIECE):
            digest.update(piece)
            size += len(piece)
        return path, rows, size, digest.hexdigest()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([one(p) for p in f["path"]], columns=["path", "n_rows", "bytes", "sha256"])

    if not paths:
        return spark.createDataFrame([], FILES)
    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInPandas(read, FILES)


def _manifest(root: str, name: str) -> str:
    return f"{root}/{name}/manifest.json"


def freeze(spark: SparkSession, root: str, name: str, paths: Sequence[str], told: dict | None = None, hashes: bool = True) -> dict:
    """Make a snapshot of files; refused if there is none of them or the name is taken."""
    if not paths:
        raise ValidationError("nothing to freeze")
    part = f"files-{uuid.uuid4().hex}"
    described(spark, paths, hashes).coalesce(1).write.parquet(f"{root}/{name}/{part}")
    sums = spark.read.parquet(f"{root}/{name}/{part}").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes")).first().asDict()
    out = sums | (told or {}) | {"name": name, "files": part}
    if not put_if_absent(spark, _manifest(root, name), json.dumps(out, sort_keys=True).encode()):
        fs, p = file_system(spark, f"{root}/{name}/{part}")
        fs.delete(p, True)
        raise FileExistsError(f"{root}/{name}")
    return out


def manifest_of(spark: SparkSession, root: str, name: str) -> dict:
    if "manifest.json" not in names_in(spark, f"{root}/{name}"):
        raise KeyError(name)
    return json.loads(read_bytes(spark, _manifest(root, name)))


def files_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{root}/{name}/{manifest_of(spark, root, name)['files']}")


def names(spark: SparkSession, root: str) -> list[str]:
    return [n for n in names_in(spark, root) if "manifest.json" in names_in(spark, f"{root}/{n}")]


def read_snapshot(spark: SparkSession, root: str, name: str, verify: bool = False) -> DataFrame:
    """The rows as they were; with ``verify`` an error names files that are no longer what they were."""
    files = files_of(spark, root, name)
    listed = files.collect()  # one row for each file
    if verify:
        now = described(spark, [r["path"] for r in listed], listed[0]["sha256"] is not None)
        bad = files.join(now.select("path", F.struct("n_rows", "bytes", "sha256").alias("now")), "path", "left").where(~F.struct("n_rows", "bytes", "sha256").eqNullSafe(F.col("now")))
        if odd := [r["path"] for r in bad.limit(10).collect()]:
            raise ValidationError(f"files have changed: {odd}")
    return spark.read.option("mergeSchema", "true").parquet(*(r["path"] for r in listed))


def unreferenced(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """Those of the files (a column ``path``) that no snapshot lists."""
    kept = spark.createDataFrame([], "path string")
    for n in names(spark, root):
        kept = kept.unionByName(files_of(spark, root, n).select("path"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return paths.join(kept.select(plain("path").alias("_kept")).distinct(), plain("path") == F.col("_kept"), "left_anti")
