"""Catalogues on any file system that Spark reads."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moraine.errors import SchemaVersionError
from moraine.operators import filters as Q

NAMES = ("catalog", "conifold_catalog", "designated_vacua_catalog", "class_catalog", "run_log", "vacua_catalog")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, root: str, suffix: str = ".parquet", hidden: bool = True) -> list[str]:
    """Files under a folder in order; hidden ones (``_``, ``.``) too, which Spark's own listing leaves out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(root)
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        path = it.next().getPath().toString()
        if path.endswith(suffix) and (hidden or not re.search(r"/[_.][^/]*$", path)):
            out.append(path)
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def check_schema_version(spark: SparkSession, root: str, expected: int, dataset: str | None = None) -> int | None:
    """The version in ``schema.json``: an error if it is another than expected; None if there is no file, and with a warning if it tells none."""
    path = f"{root}/schema.json"
    if not exists(spark, path):
        return None
    told = json.loads(read_text(spark, path))
    if dataset is not None and told.get("dataset") not in (None, dataset):
        raise SchemaVersionError(f"{path} is of {told.get('dataset')}, not {dataset}")
    version = told.get("schema_version")
    if version is None:
        warnings.warn(f"{path} tells no schema version", stacklevel=2)
        return None
    if version != expected:
        kind = "newer" if isinstance(version, int) and version > expected else "older"
        raise SchemaVersionError(f"{path} has schema version {version}; this code reads {expected} ({kind} data)")
    return version


def find_root(spark: SparkSession, path: str, markers: Sequence[str] = ("catalog.parquet", "schema.json")) -> str:
    """The folder or its parent, whichever holds a marker."""
    for root in (path.rstrip("/"), path.rstrip("/").rpartition("/")[0]):
        if root and any(exists(spark, f"{root}/{m}") for m in markers):
            return root
    raise FileNotFoundError(f"none of {list(markers)} at {path} or above it")


class Catalog:
    """A dataset's tables, each read when first asked for."""

    def __init__(self, spark: SparkSession, root: str, schema_version: int | None = None, mirrored: bool = False) -> None:
        self.spark, self.mirrored = spark, mirrored
        self.root = find_root(spark, root)
        if schema_version is not None:
            check_schema_version(spark, self.root, schema_version)
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str, schema: StructType | None = None, empty: bool = False) -> DataFrame:
        """One of the named tables; a missing one is an error, or an empty table of its schema."""
        if name not in NAMES:
            raise ValueError(f"no table {name!r}; there are {list(NAMES)}")
        if name not in self._tables:
            path = f"{self.root}/{name}.parquet"
            if not exists(self.spark, path):
                if not (empty and schema is not None):
                    raise FileNotFoundError(path)
                self._tables[name] = self.spark.createDataFrame([], schema)
            else:
                reader = self.spark.read if schema is None else self.spark.read.schema(schema)
                self._tables[name] = reader.parquet(path)
        return self._tables[name]

    def refresh(self) -> None:
        self._tables.clear()

    @cached_property
    def catalog(self) -> DataFrame:
        return self.table("catalog")

    def query(self, **filters) -> DataFrame:
        return Q.mirror_query(self.catalog, mirrored=not self.mirrored, **filters)

    def query_conifolds(self, **filters) -> DataFrame:
        return Q.mirror_query_conifolds(self.table("conifold_catalog"), mirrored=not self.mirrored, **filters)

    def split(self, name: str, shard_ids: Sequence[int] | None = None) -> DataFrame:
        """Shards of a split with ``shard_id`` and ``row_index`` from where a row lies; all, or those of the given numbers.

        Filters on row_index reach the scan.
        """
        reader = self.spark.read.option("recursiveFileLookup", "true")
        if shard_ids is not None:
            # names are padded with zeros to five digits or more
            names = "{" + ",".join(f"data-{int(k):05d}.parquet" for k in sorted(set(shard_ids))) + "}"
            reader = reader.option("pathGlobFilter", names if shard_ids else "none").schema(self._schema(name))
        return with_place(reader.parquet(f"{self.root}/{name}"))

    def _schema(self, name: str) -> StructType:
        """The schema of a split, read once."""
        key = f"{name}/"
        if key not in self._tables:
            self._tables[key] = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")
        return self._tables[key].schema

    def load(self, split: str, shard: str, row: str, keys: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
        """Catalogue rows with the detail rows they point to, one nested row each.

        With keys, only the shards that their rows point to are opened.
        """
        from moraine.operators.joins import pointer_join, small

        if keys is None:
            return pointer_join(self.catalog, self.split(split), shard, row)
        picked = self.catalog.join(small(keys), list(on), "left_semi")
        wanted = [r[0] for r in picked.select(shard).where(F.col(shard).isNotNull()).distinct().collect()]  # as many as shards at most
        return pointer_join(picked, self.split(split, wanted), shard, row)


def with_place(df: DataFrame) -> DataFrame:
    """shard_id (the number in the file's name), file and row_index of each row."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"data-(\d+)\.parquet$", 1).try_cast("int").alias("shard_id"), F.regexp_extract(path, r"h11_(\d+)", 1).try_cast("int").alias("h11_of_path"), path.alias("file"), F.col("_metadata.row_index").alias("row_index"))


def rows_of_shard(df: DataFrame, shard_id: int, where=None, row: int | None = None) -> DataFrame:
    """Rows of one shard, by a condition or by number."""
    out = df.where(F.col("shard_id") == shard_id)
    out = out if where is None else out.where(where)
    return out if row is None else out.where(F.col("row_index") == row)


def row_range(df: DataFrame, shard_id: int, row0: int, n: int) -> DataFrame:
    """n rows of a shard from row0.  The shard's other row groups are read too; ``rowgroups.row_range`` leaves them out."""
    return df.where((F.col("shard_id") == shard_id) & F.col("row_index").between(row0, row0 + n - 1))


def query_models(spark: SparkSession, root: str, **filters) -> DataFrame:
    """A catalogue query in one call."""
    return Q.query_catalog(Catalog(spark, root).catalog, **filters)


def load_catalog(spark: SparkSession, root: str, name: str = "catalog") -> DataFrame:
    return Catalog(spark, root).table(name)


class PhaseStore:
    """The sharded store of phases: ``{mode}/catalog/h11_N/data-*.parquet`` and beside it geom and polytopes."""

    def __init__(self, spark: SparkSession, root: str, schema_version: int = 3) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        check_schema_version(spark, self.root, schema_version)
        self.modes = [m for m in ("frst", "vex") if exists(spark, f"{self.root}/{m}/catalog")]

    def _dir(self, part: str, h11: int | None) -> DataFrame:
        path = f"{self.root}/{part}" if h11 is None else f"{self.root}/{part}/h11_{int(h11)}"
        files = [f for f in list_files(self.spark, path) if re.search(r"/data-\d+\.parquet$", f)]  # index files start with _ and are no data
        if not files:
            raise FileNotFoundError(path)
        return with_place(self.spark.read.parquet(*files))

    def _mode(self, mode: str) -> str:
        if mode not in self.modes:
            raise ValueError(f"no mode {mode!r}; there are {self.modes}")
        return mode

    def query(self, mode: str, h11: int, **filters) -> DataFrame:
        return Q.query_phases(self._dir(f"{self._mode(mode)}/catalog", h11), mode, h11, **filters)

    def query_polytopes(self, h11: int, **filters) -> DataFrame:
        vex = self._dir("polytope_vex_counts", h11).drop("shard_id", "h11_of_path", "file", "row_index") if exists(self.spark, f"{self.root}/polytope_vex_counts/h11_{h11}") else None
        return Q.query_toric_polytopes(self._dir("polytope_catalog", h11), h11, vex, **filters)

    def get_polytope(self, h11: int, ks_id: int) -> DataFrame:
        meta, geom = self._dir("polytope_catalog", h11).where(F.col("ks_id") == ks_id), self._dir("polytope", h11)
        return meta.join(geom.select("h11", "ks_id", *(c for c in geom.columns if c not in meta.columns)), ["h11", "ks_id"])

    def load(self, mode: str, h11: int, ks_id: int, triang_id: int) -> DataFrame:
        """One phase with tensors and polytope, in one row."""
        from moraine.operators.joins import phase_with_geometry

        own = self.query(mode, h11, ks_id=ks_id, triang_id=triang_id)
        place = ["shard_id", "h11_of_path", "file", "row_index"]
        return phase_with_geometry(own.drop(*place), self._dir(f"{mode}/geom", h11).drop(*place), self._dir("polytope", h11).drop(*place))

    def info(self) -> DataFrame:
        """Phases by mode and h11 with totals; counts come from the files' footers."""
        from moraine.operators.aggregates import counts_with_total
        from moraine.operators.sets import union_all

        parts = [self._dir(f"{m}/catalog", None).select(F.lit(m).alias("mode"), F.col("h11_of_path").alias("h11")) for m in self.modes]
        return counts_with_total(union_all(*parts), "mode", "h11")
