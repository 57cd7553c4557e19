"""Run logs, session runs and stage fragments as append-only tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions import ids
from moraine.operators.filters import exact, where_all
from moraine.operators.joins import anti, semi
from moraine.operators.sets import union_all
from moraine.operators.windows import first_of, latest, merge_logs
from moraine.schemas import RUN_CATALOG, RUN_LOG, SESSION_ROW, conform
from moraine.sources.catalog import exists
from moraine.sources.commits import COMPACT, CommitLog, Tops, with_seq
from moraine.sources.shared import file_system, kept, names_in

ENTITY = ("scope", "ks_id", "coni_class_id", "coni_id")


class RunLog:
    """Events of runs; ``seq`` is the order of appending, by any number of writers at once."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT) -> None:
        self.spark, self.path = spark, path
        self.log = CommitLog(spark, path, RUN_LOG, compact_every)
        self.tops = Tops(self.log, "attempt_index", ENTITY)

    def read(self) -> DataFrame:
        return self.log.read()

    def start(self, scope: str, ks_id: int, coni_class_id: int | None = None, coni_id: int | None = None, run_id: str | None = None, now: datetime | None = None, **more) -> str:
        """A new attempt at an entity: one more than the largest so far."""
        if scope not in ("class", "conifold"):
            raise ValueError("scope must be 'class' or 'conifold'")
        if coni_class_id is None or (scope == "conifold") != (coni_id is not None):
            raise ValueError("a class needs its id, a conifold also its own, a class no conifold")
        key = dict(zip(ENTITY, (scope, ks_id, coni_class_id, coni_id), strict=True))
        event = key | {"run_id": run_id or uuid.uuid4().hex, "status": "running", "started_at": now or datetime.now(timezone.utc)} | more
        self._check(event)
        return self.log.commit(lambda old, rows: event | {"attempt_index": (self.tops.of(old, rows, key) or 0) + 1})["run_id"]

    def finish(self, run_id: str, status: str = "done", now: datetime | None = None, **more) -> None:
        """A second event of the run, its attempt and start carried along."""
        self._check(more)

        def event(old: DataFrame | None, rows: list[dict]) -> dict:
            held = next((r for r in reversed(rows) if r["run_id"] == run_id), None)
            if held is None and old is not None:
                last = latest(old.where(F.col("run_id") == run_id), ["run_id"], ["seq"]).collect()
                held = last[0].asDict() if last else None
            if held is None:
                raise KeyError(run_id)
            return held | {"status": status, "finished_at": now or datetime.now(timezone.utc)} | more

        self.log.commit(event)

    @staticmethod
    def _check(event: dict) -> None:
        if unknown := set(event) - set(RUN_LOG.names):
            raise TypeError(f"an event has no {sorted(unknown)}")

    def cancel(self, run_id: str, **more) -> None:
        self.finish(run_id, "cancelled", **more)

    def list(self, **filters) -> DataFrame:
        df = self.read()
        return where_all(df, exact(df, filters)).orderBy("seq")

    def status(self) -> DataFrame:
        """The last event of each entity."""
        return latest(self.read(), ENTITY, ["seq"])

    def merge(self, other: DataFrame) -> DataFrame:
        return merge_logs(self.read(), other, ties=["seq"])

    def push(self, path: str) -> None:
        """This log merged into the one at ``path``, as one Parquet table; the merge is read before it is written."""
        out = self.merge(self.spark.read.schema(RUN_LOG).parquet(path)) if exists(self.spark, path) else self.read()
        temp = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        out.write.parquet(temp)
        swap_dirs(self.spark, temp, path)


#: An event of a session store: a run that was written, or the deletion of one.
_EVENT = with_seq(T.StructType([T.StructField("op", T.StringType()), T.StructField("run_ids", T.ArrayType(T.StringType())), *RUN_CATALOG.fields]))


class SessionStore:
    """Runs of solutions: a folder of rows by run, and a log of what was written and deleted.

    A run is there once its commit is; rows of a writer that died before are not read.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits", _EVENT, compact_every)

    @property
    def runs(self) -> DataFrame:
        events = self.log.read()
        gone = events.where("op = 'delete'").select(F.explode("run_ids").alias("run_id"))
        return anti(events.where("op = 'write'"), gone, ["run_id"]).select(*RUN_CATALOG.names)

    @property
    def rows(self) -> DataFrame:
        path = f"{self.root}/rows"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], SESSION_ROW).withColumn("run_id", F.lit(None).cast("string"))
        # the schema of stored rows, whatever else a row brought along
        return semi(self.spark.read.option("mergeSchema", "true").parquet(path), self.runs, ["run_id"])

    def _commit(self, runs: Sequence[dict]) -> None:
        for run in runs:
            self.log.commit(lambda old, rows, run=run: {"op": "write"} | run)

    def write(self, df: DataFrame, identity: dict, order: Sequence[str], method: str | None = None, run_id: str | None = None, metadata: str | None = None, dedup: bool = True, keep: Column | None = None, now: datetime | None = None) -> tuple[str, int, int]:
        """(run id, rows written, rows skipped as known).

        A solution is known if its model has its flux; of equals in the batch the first counts,
        before ``keep`` is applied.  No rows, no run.
        """
        run_id = run_id or uuid.uuid4().hex
        told = df.withColumns({f"_m_{k}": F.lit(v) for k, v in identity.items()})
        names = {k: f"_m_{k}" for k in identity}
        report = self._write(told, names, order, method, metadata, dedup, keep, now, F.lit(run_id)).collect()
        return (run_id, report[0]["n_written"], report[0]["n_skipped"]) if report else (run_id, 0, 0)

    def write_models(self, df: DataFrame, model: Sequence[str], order: Sequence[str], method: str | None = None, metadata: str | None = None, dedup: bool = True, keep: Column | None = None, now: datetime | None = None) -> DataFrame:
        """One run for each model of the rows; a row for each with what was written.

        All models go in one pass and one write; known solutions, the order and ``keep`` are as
        in ``write``.  A run's id is a hash of a random batch number and its model.
        """
        return self._write(df, {k: k for k in model}, order, method, metadata, dedup, keep, now, None)

    def _write(self, df: DataFrame, names: dict[str, str], order: Sequence[str], method: str | None, metadata: str | None, dedup: bool, keep: Column | None, now: datetime | None, run_id: Column | None) -> DataFrame:
        """``names`` gives the column of ``df`` for each key of a model."""
        told = lambda of: F.concat_ws("|", *(F.coalesce(F.col(of(k)).cast("string"), F.lit("null")) for k in names))
        id_ = run_id if run_id is not None else F.md5(F.concat_ws("|", F.lit(uuid.uuid4().hex), "_model"))
        marked = df.withColumns({"_model": told(names.get), "_flux": ids.canonical_flux("flux")}).withColumn("run_id", id_)
        fresh = marked
        if dedup:
            stored = self.rows.join(self.runs.select("run_id", told(lambda k: k).alias("_model")), "run_id").select("_model", ids.canonical_flux("flux").alias("_flux"))
            fresh = first_of(anti(marked, stored, ["_model", "_flux"]), ["_model", "_flux"], order)
        kept_ = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
        # what is counted is what is stored: both come from one writing
        fresh = kept(fresh.withColumn("_kept", kept_))
        counts = fresh.groupBy("_model").agg(F.count("*").alias("n_new"), F.count_if("_kept").alias("n_written"))
        report = marked.groupBy("_model", "run_id", *(F.col(c).alias(k) for k, c in names.items())).agg(F.count("*").alias("n")).join(counts, "_model", "left")
        report = report.select(*names, "run_id", F.coalesce("n_written", F.lit(0).cast("long")).alias("n_written"), (F.col("n") - F.coalesce("n_new", F.lit(0))).alias("n_skipped"))
        done = report.collect()  # one row for each geometry of a batch
        conform(fresh.where("_kept").drop(*names.values(), "_model", "_flux", "_kept"), SESSION_ROW).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/rows")
        common = {"method": method, "metadata": metadata, "created": now or datetime.now(timezone.utc)}
        self._commit([{k: r[k] for k in (*names, "run_id")} | common | {"n_vacua": r["n_written"], "file_path": f"rows/run_id={r['run_id']}"} for r in done if r["n_written"]])
        return self.spark.createDataFrame(done, report.schema)

    def load(self, run_id: str) -> DataFrame:
        if self.runs.where(F.col("run_id") == run_id).isEmpty():
            raise KeyError(run_id)
        return self.rows.where(F.col("run_id") == run_id)

    def delete(self, **filters) -> int:
        """Runs that match, all of them if none is asked for; how many went.

        One commit, after which no reader sees them; then their folders go.  If that is cut
        short, ``vacuum`` removes what is left.
        """
        runs = self.runs
        gone = [r[0] for r in where_all(runs, exact(runs, filters)).select("run_id").collect()]  # one row for each run
        if gone:
            self.log.commit(lambda old, rows: {"op": "delete", "run_ids": gone})
            self._remove(gone)
        return len(gone)

    def _remove(self, run_ids: Sequence[str]) -> None:
        for run_id in run_ids:
            fs, p = file_system(self.spark, f"{self.root}/rows/run_id={run_id}")
            fs.delete(p, True)

    def vacuum(self) -> int:
        """Remove the rows of deleted runs that are still there; how many runs that were."""
        gone = {r[0] for r in self.log.read().where("op = 'delete'").select(F.explode("run_ids")).collect()}
        left = [n.removeprefix("run_id=") for n in names_in(self.spark, f"{self.root}/rows") if n.removeprefix("run_id=") in gone]
        self._remove(left)
        return len(left)

    def writer(self, identity: dict, method: str | None = None, metadata: str | None = None, run_id: str | None = None, max_rows: int = 50_000, max_bytes: int = 32 << 20, **write) -> SessionWriter:
        return SessionWriter(self, identity, method, metadata, run_id, max_rows, max_bytes, write)


class SessionWriter:
    """Solutions gathered row by row or in tables, and stored as one run at the end.

    Rows are held up to ``max_rows`` or about ``max_bytes`` and then spilled to the store's
    staging folder.  Leaving the block stores all of them with one commit; leaving it by an
    error stores nothing.  ``result`` is what ``SessionStore.write`` returned.
    """

    def __init__(self, store: SessionStore, identity: dict, method: str | None, metadata: str | None, run_id: str | None, max_rows: int, max_bytes: int, write: dict) -> None:
        self.store, self.identity, self.method, self.metadata = store, identity, method, metadata
        self.run_id, self.max_rows, self.max_bytes, self.more = run_id or uuid.uuid4().hex, max_rows, max_bytes, write
        self.staging, self.result = f"{store.root}/.staging-{self.run_id}", None
        self._held: list[dict] = []
        self._bytes = self._spills = self._count = 0

    def append(self, **row) -> None:
        """One solution; columns of the stored schema by name, others go into extra_data."""
        if row.get("flux") is None:
            raise ValueError("a solution needs its flux")
        known = {k: v for k, v in row.items() if k in SESSION_ROW.names}
        if extra := {k: v for k, v in row.items() if k not in known}:
            known["extra_data"] = json.dumps(json.loads(known.get("extra_data") or "{}") | extra, sort_keys=True, default=str)
        self._held.append(known | {"_at": self._count})
        self._count += 1
        self._bytes += sum(8 * len(v) if isinstance(v, (list, tuple)) else len(v) if isinstance(v, str) else 8 for v in known.values())
        if len(self._held) >= self.max_rows or self._bytes >= self.max_bytes:
            self.flush()

    def append_batch(self, rows: DataFrame | Iterable[dict]) -> None:
        """Many solutions; a table goes to the staging folder without passing through the driver."""
        if not isinstance(rows, DataFrame):
            for row in rows:
                self.append(**row)
            return
        self.flush()
        own = conform(rows, SESSION_ROW, keep_unknown=False) if set(SESSION_ROW.names) <= set(rows.columns) else conform(rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in SESSION_ROW.fields if f.name not in rows.columns}), SESSION_ROW, keep_unknown=False)
        self._spill(own.withColumn("_at", F.lit(self._count) + F.monotonically_increasing_id()))
        self._count += 1 << 53

    def flush(self) -> None:
        """Spill what is held."""
        if self._held:
            schema = T.StructType([*SESSION_ROW.fields]).add("_at", T.LongType())
            self._spill(self.store.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in self._held], schema).coalesce(1))
            self._held, self._bytes = [], 0

    def _spill(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.staging}/{self._spills}")
        self._spills += 1

    def __enter__(self) -> SessionWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        fs, p = file_system(self.store.spark, self.staging)
        try:
            if kind is None:
                self.flush()
                if self._spills:
                    schema = T.StructType([*SESSION_ROW.fields]).add("_at", T.LongType())
                    staged = self.store.spark.read.schema(schema).parquet(*(f"{self.staging}/{k}" for k in range(self._spills)))
                    self.result = self.store.write(staged, self.identity, ["_at"], self.method, self.run_id, self.metadata, **self.more)
                else:
                    self.result = (self.run_id, 0, 0)
        finally:
            fs.delete(p, True)


def swap_dirs(spark: SparkSession, new: str, old: str) -> None:
    """Put a written folder in another's place; at any moment one of the two is whole."""
    fs, a = file_system(spark, new)
    _, b = file_system(spark, old)
    _, aside = file_system(spark, f"{old.rstrip('/')}.replaced-{uuid.uuid4().hex}")
    there = fs.exists(b)
    if there and not fs.rename(b, aside):
        raise OSError(f"{old} could not be moved")
    if not fs.rename(a, b):
        if there:
            fs.rename(aside, b)
        raise OSError(f"{new} could not be put in the place of {old}")
    fs.delete(aside, True)


def write_fragment(df: DataFrame, path: str, stage: str, kind: str, run_id: str, identity: dict, **columns) -> None:
    """Append a stage's rows, stamped with identity and run; other values are one for every row."""
    stamped = df.withColumns({k: F.lit(v) for k, v in {**identity, "run_id": run_id, "stage": stage, "kind": kind}.items()})
    for k, v in columns.items():
        stamped = stamped.withColumn(k, F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v))
    stamped.write.mode("append").partitionBy("stage", "kind", "ks_id", "coni_class_id", "run_id").parquet(path)


def read_fragments(spark: SparkSession, path: str, stage: str | None = None, kind: str | None = None, **identity) -> DataFrame:
    """Rows of all fragments that match; what is not given matches everything, and prunes nothing."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return where_all(df, [F.col(k) == v for k, v in {"stage": stage, "kind": kind, **identity}.items() if v is not None])


def merged(*logs: DataFrame) -> DataFrame:
    return union_all(*logs)
