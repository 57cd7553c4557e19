"""Production shards: staged writes, publishing in batches under a budget, and reading by catalogue.

A shard holds the rows of one geometry and run.  What Spark cannot see in a Parquet footer
is kept beside the shard as JSON, and in the shard catalogue with the columns it has.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
import warnings
from collections import deque
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.errors import SchemaVersionError, ValidationError
from moraine.functions import ids
from moraine.functions.text import safe_run_id
from moraine.operators.filters import exact, where_all
from moraine.operators.joins import small
from moraine.operators.sets import union_all
from moraine.operators.vetting import validate_schema
from moraine.schemas import GEOMETRY_KEYS, PRODUCTION, SHARD_CATALOG, conform

SCHEMA_VERSION = 1
STATES = ("pending", "synced", "failed")
FILTER_KEYS = ("run_id", "geometry_id", "h11", "h12", "ks_id", "triang_id")


def coerce(df: DataFrame, run_id: str, keys: dict[str, int], **provenance) -> DataFrame:
    """Run, geometry and its keys set for every row; solver and provenance only where rows lack them."""
    own = {k: F.lit(int(keys.get(k, -1))).cast("int") for k in GEOMETRY_KEYS}
    out = df.withColumns(own | {"run_id": F.lit(run_id), "geometry_id": ids.geometry_id(**{k: int(keys.get(k, -1)) for k in GEOMETRY_KEYS})})
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    for k, v in provenance.items():
        if v is not None and k not in out.columns:
            out = out.withColumn(k, F.lit(v))
    return conform(out, PRODUCTION)


@dataclass(frozen=True)
class StagedShard:
    path: str
    sidecar: str
    run_id: str
    geometry_id: str
    n_rows: int


def ensure_layout(root: str | Path) -> Path:
    root = Path(root)
    for s in STATES:
        (root / s).mkdir(parents=True, exist_ok=True)
    return root


def write_shard(df: DataFrame, root: str | Path, run_id: str, keys: dict[str, int], bits: int = 4, **provenance) -> StagedShard:
    """Write one shard into ``pending`` of a staging folder that the driver and executors share.

    Both files appear at once or not at all; the same run and geometry replaces what it wrote.
    """
    if not safe_run_id(run_id):
        raise ValueError(f"not a valid run id: {run_id!r}")
    if all(int(keys.get(k, -1)) < 0 for k in GEOMETRY_KEYS):
        raise ValueError("a geometry needs at least one key")
    rows = coerce(df, run_id, keys, **provenance)
    n = rows.count()
    if not n:
        raise ValueError("a shard needs rows")
    validate_schema(rows)
    root = ensure_layout(root)
    name = rows.select(F.regexp_replace(ids.shard_path("h11", "h12", "geometry_id", "run_id", bits), "/", "__").alias("p"), "geometry_id").first()
    final, side = root / "pending" / name["p"], root / "pending" / (name["p"].removesuffix(".parquet") + ".json")
    work = root / f".tmp-{uuid.uuid4().hex}"
    try:
        rows.coalesce(1).write.parquet(str(work))  # a shard is one file by contract
        made = next(work.glob("part-*.parquet"))
        told = {"run_id": run_id, "geometry_id": name["geometry_id"], "schema_version": SCHEMA_VERSION, "n_rows": n, "columns": rows.columns, **{k: int(keys.get(k, -1)) for k in GEOMETRY_KEYS}}
        (work / "side").write_text(json.dumps(told, sort_keys=True))
        os.replace(made, final)
        os.replace(work / "side", side)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return StagedShard(str(final), str(side), run_id, name["geometry_id"], n)


def write_table(df: DataFrame, path: str) -> None:
    """Many geometries and runs at once into one table: a partition for each bucket; a run written
    again replaces the partitions it is in."""
    out = conform(df, PRODUCTION).withColumn("bucket", ids.bucket("geometry_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("h12", "h11", "bucket", "run_id").parquet(path)


def list_state(root: str | Path, state: str = "pending") -> list[StagedShard]:
    """Shards of a state that have both files, in order."""
    out = []
    for p in sorted((Path(root) / state).glob("*.parquet")):
        side = p.with_suffix(".json")
        try:
            told = json.loads(side.read_text())
        except (OSError, ValueError):
            continue
        out.append(StagedShard(str(p), str(side), told["run_id"], told["geometry_id"], told["n_rows"]))
    return out


def move(shard: StagedShard, root: str | Path, state: str) -> StagedShard:
    if state not in STATES:
        raise ValueError(state)
    to = [Path(root) / state / Path(x).name for x in (shard.path, shard.sidecar)]
    for a, b in zip((shard.path, shard.sidecar), to, strict=True):
        os.replace(a, b)
    return StagedShard(str(to[0]), str(to[1]), shard.run_id, shard.geometry_id, shard.n_rows)


# --- publishing ---------------------------------------------------------------------


class RateLimited(RuntimeError):
    def __init__(self, retry_after: float | None = None) -> None:
        super().__init__("rate limited")
        self.retry_after = retry_after


class Transient(RuntimeError):
    pass


class Publisher(Protocol):
    """Where batches of shards go: all of a batch, or an error and nothing."""

    def commit(self, files: Sequence[tuple[str, str]]) -> str: ...


class FolderPublisher:
    """A folder: files are put beside their places, then renamed."""

    def __init__(self, root: str | Path) -> None:
        self.root = Path(root)

    def commit(self, files: Sequence[tuple[str, str]]) -> str:
        made = []
        try:
            for source, to in files:
                target = self.root / to
                target.parent.mkdir(parents=True, exist_ok=True)
                temp = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
                shutil.copyfile(source, temp)
                made.append((temp, target))
        except OSError:
            for temp, _ in made:
                temp.unlink(missing_ok=True)
            raise
        for temp, target in made:
            os.replace(temp, target)
        return uuid.uuid4().hex


class CommitBudget:
    """At most ``budget`` commits in any ``window_s``; kept in a file between processes."""

    def __init__(self, path: str | Path | None = None, budget: int = 90, window_s: float = 3600.0) -> None:
        self.path, self.budget, self.window_s = Path(path) if path else None, budget, window_s
        self.times: deque[float] = deque()
        if self.path and self.path.exists():
            try:
                self.times.extend(json.loads(self.path.read_text())["times"])
            except (ValueError, KeyError):
                warnings.warn(f"{self.path} cannot be read; the budget starts anew", stacklevel=2)

    def _prune(self, now: float) -> None:
        while self.times and self.times[0] < now - self.window_s:
            self.times.popleft()

    def recent(self, now: float | None = None) -> int:
        self._prune(time.time() if now is None else now)
        return len(self.times)

    def remaining(self, now: float | None = None) -> int:
        return max(0, self.budget - self.recent(now))

    def wait_s(self, now: float | None = None) -> float:
        now = time.time() if now is None else now
        return 0.0 if self.remaining(now) else max(0.0, self.times[0] + self.window_s - now)

    def reserve(self, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        if not self.remaining(now):
            return False
        self.times.append(now)
        if self.path:
            temp = self.path.with_suffix(".tmp")
            temp.write_text(json.dumps({"times": list(self.times)}))
            os.replace(temp, self.path)
        return True


def backoff(attempt: int, retry_after: float | None = None, initial: float = 1.0, cap: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> float:
    """Wait ``initial`` doubled with each attempt, ``cap`` at most, but never less than was asked for."""
    if attempt < 0:
        raise ValueError("attempt must not be negative")
    s = max(min(cap, initial * 2**attempt), retry_after or 0.0)
    sleep(s)
    return s


def parse_retry_after(value: str | None) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


@dataclass
class SyncReport:
    n_synced: int = 0
    n_failed: int = 0
    n_left: int = 0
    n_commits: int = 0
    errors: list[str] = field(default_factory=list)


def sync(root: str | Path, publisher: Publisher, budget: CommitBudget, max_batch: int = 500, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> SyncReport:
    """Publish pending shards in batches, each within the budget; a batch that fails for good is set aside."""
    report = SyncReport()
    pending = list_state(root)
    for k in range(0, len(pending), max_batch):
        part = pending[k : k + max_batch]
        if not budget.reserve():
            report.n_left += len(pending) - k
            break
        files = [(x.path, Path(x.path).name.replace("__", "/")) for x in part]
        state = "failed"
        for attempt in range(retries + 1):
            try:
                publisher.commit(files)
                state = "synced"
                break
            except (RateLimited, Transient) as e:
                report.errors.append(repr(e))
                if attempt < retries:
                    backoff(attempt, getattr(e, "retry_after", None), sleep=sleep)
            except Exception as e:  # not worth trying again
                report.errors.append(repr(e))
                break
        for x in part:
            move(x, root, state)
        report.n_commits += state == "synced"
        report.n_synced += len(part) * (state == "synced")
        report.n_failed += len(part) * (state == "failed")
    return report


# --- reading ------------------------------------------------------------------------


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row for each file from its footer alone: path, rows, columns and their types, key-value metadata, error.

    Executors read the ends of the files by ranges, so a file's size does not matter.  Files of
    a scheme that pyarrow does not know come through Spark's reader, and so whole.
    """
    import io

    import pandas as pd
    import pyarrow.parquet as pq
    from pyarrow import fs

    out = "path string, n_rows long, columns array<string>, types array<string>, metadata map<string,string>, error string"
    names = ["path", "n_rows", "columns", "types", "metadata", "error"]

    def told(path: str, source) -> tuple:
        try:
            x = pq.ParquetFile(source())
            kv = {k.decode(): v.decode("utf-8", "replace") for k, v in (x.schema_arrow.metadata or {}).items()}
            return path, x.metadata.num_rows, x.schema_arrow.names, [str(t) for t in x.schema_arrow.types], kv, None
        except Exception as e:  # a file that cannot be read is reported, not fatal
            return path, -1, [], [], {}, repr(e)

    def opened(path: str):
        where = "file://" + re.sub("^file:/+", "/", path) if path.startswith(("/", "file:")) else path
        system, name = fs.FileSystem.from_uri(where)
        return system.open_input_file(name)

    def by_range(frames: Iterable[pd.DataFrame]):
        for f in frames:
            yield pd.DataFrame([told(p, lambda p=p: opened(p)) for p in f["path"]], columns=names)

    def whole(frames: Iterable[pd.DataFrame]):
        for f in frames:
            yield pd.DataFrame([told(p, lambda c=c: io.BytesIO(c)) for p, c in zip(f["path"], f["content"], strict=True)], columns=names)

    known = [p for p in paths if p.startswith("/") or p.partition(":")[0] in ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")]
    other = [p for p in paths if p not in set(known)]
    parts = []
    if known:
        tasks = max(1, min(len(known), 4 * spark.sparkContext.defaultParallelism))
        parts.append(spark.createDataFrame([(p,) for p in known], "path string").repartition(tasks).mapInPandas(by_range, out))
    if other:
        parts.append(spark.read.format("binaryFile").load(other).select("path", "content").mapInPandas(whole, out))
    return union_all(*parts) if parts else spark.createDataFrame([], out)


def shard_catalog(spark: SparkSession, root: str, strict: bool = False) -> tuple[DataFrame, int]:
    """(one row for each shard, sorted by path; how many could not be read).

    Keys come from the rows' own first values, or from the path of a table that is partitioned by
    them, versions from metadata where there are any.  A
    shard of another version is told, or an error with ``strict``.
    """
    from moraine.sources.catalog import list_files

    paths = [p for p in list_files(spark, root) if "/." not in p]
    foot = footers(spark, paths).cache()
    bad = foot.where("error is not null").count()
    if bad:
        warnings.warn(f"{bad} shards cannot be read", stacklevel=2)
    good = foot.where("error is null")
    version = F.coalesce(F.try_element_at("metadata", F.lit("schema_version")).try_cast("int"), F.lit(SCHEMA_VERSION))
    other = good.where(version != SCHEMA_VERSION).count()
    if other and strict:
        raise SchemaVersionError(f"{other} shards have another schema version")
    if other:
        warnings.warn(f"{other} shards have another schema version", stacklevel=2)
    readable = [r[0] for r in good.select("path").collect()]  # one row for each file
    if not readable:
        return spark.createDataFrame([], SHARD_CATALOG), bad
    keys = spark.read.schema(PRODUCTION).parquet(*readable).groupBy(F.col("_metadata.file_path").alias("p")).agg(*(F.first(c, ignorenulls=True).alias(f"_{c}") for c in ("run_id", "geometry_id", *GEOMETRY_KEYS)))
    both = good.join(keys, _plain("path") == _plain("p"), "left")
    own = [F.coalesce(F.col(f"_{c}"), _of_path(c, F.col("path"))).alias(c) if c in PATH_KEYS else F.col(f"_{c}").alias(c) for c in ("run_id", "geometry_id", *GEOMETRY_KEYS)]
    there = F.array_union("columns", F.array_compact(F.array(*(F.when(_of_path(c, F.col("path")).isNotNull(), c) for c in PATH_KEYS))))
    out = both.select("path", *own, version.alias("schema_version"), "n_rows", F.array_join(there, ",").alias("columns"))
    return out.orderBy("path"), bad


def query_shards(spark: SparkSession, catalog: DataFrame, columns: Sequence[str] | None = None, is_susy: bool | None = None, cert_status: str | None = None, solver_name: str | None = None, **keys) -> DataFrame:
    """Rows of the shards whose keys match.  A row filter holds only for shards that have its column;
    a shard without it keeps all its rows.  Null in a shard that has the column does not match."""
    if unknown := set(keys) - set(FILTER_KEYS):
        raise TypeError(f"cannot filter on {sorted(unknown)}")
    chosen = where_all(catalog, exact(catalog, keys)).select("path", "columns")
    rows = chosen.collect()  # one row for each file
    if not rows:
        return spark.createDataFrame([], PRODUCTION)
    known = set().union(*(r["columns"].split(",") for r in rows))
    df = spark.read.schema(PRODUCTION).parquet(*(r["path"] for r in rows))
    place = _plain("_metadata.file_path").alias("_path")
    if any(c not in PRODUCTION.names for c in known):
        df = spark.read.option("mergeSchema", "true").parquet(*(r["path"] for r in rows))
        df = conform(df.select("*", place), PRODUCTION)
    else:
        df = df.select("*", place)
    df = df.withColumns({c: F.coalesce(F.col(c), _of_path(c, F.col("_path"))) for c in PATH_KEYS if c in df.columns})
    wanted = {c: v for c, v in {"is_susy": is_susy, "cert_status": cert_status, "solver_name": solver_name}.items() if v is not None and c in df.columns}
    if wanted:
        # shards of one run share a file name, so a shard is known by its whole path
        has = chosen.select(_plain("path").alias("_path"), *(F.array_contains(F.split("columns", ","), c).alias(f"_has_{c}") for c in wanted)).dropDuplicates(["_path"])
        df = df.join(small(has), "_path", "left")
        df = where_all(df, [~F.coalesce(F.col(f"_has_{c}"), F.lit(True)) | F.coalesce(F.col(c) == v, F.lit(False)) for c, v in wanted.items()])
    present = [c for c in df.columns if c in known]
    if columns is not None:
        if missing := [c for c in columns if c not in known]:
            raise KeyError(f"no columns {missing}")
        present = list(columns)
    return df.select(*present)


#: Columns that a partitioned table has in its paths.
PATH_KEYS = {"run_id": "string", "h11": "int", "h12": "int"}


def _of_path(key: str, path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, f"/{key}=([^/]+)/", 1), F.lit("")).cast(PATH_KEYS[key])


def _plain(path: str) -> Column:
    """A path without the scheme of local files, which Spark and a catalogue write differently."""
    return F.regexp_replace(F.col(path), "^file:/+", "/")


def freeze(spark: SparkSession, rows: DataFrame, catalog: DataFrame, to: str, name: str, registry=None, require_certified: bool = True) -> dict:
    """A snapshot of the catalogue's shards as a manifest, no row copied; refused if empty, or not certified throughout.

    ``rows`` are the shards' rows, which the manifest sums up.  ``snapshots.read_snapshot`` reads them as they are now.
    """
    from moraine.operators.aggregates import content_fingerprint, manifest
    from moraine.operators.vetting import fully_certified
    from moraine.sources import snapshots

    told = manifest(rows, catalog).first().asDict() | content_fingerprint(catalog, "path", "n_rows").first().asDict() | {"schema_version": SCHEMA_VERSION}
    if not told["n_records"]:
        raise ValidationError("nothing to freeze")
    if require_certified and not fully_certified(told, registry):
        raise ValidationError("not all records are certified")
    return snapshots.freeze(spark, to, name, [r[0] for r in catalog.select("path").collect()], told)  # one path for each file


def report_json(report: SyncReport) -> str:
    return json.dumps(asdict(report), sort_keys=True)
