"""Parquet files read by row groups, with an index of keys.

``build_index`` reads the footers of files in tasks and keeps a row for each row group: the file,
the group, its first row counted over all files in order, its rows, bytes and range of a key.  The
``row_groups`` data source makes a partition for each group that the index lets through, for
filters on the key (Spark pushes them down) and for a range of rows; no task is made for the
others, and of a group only the columns of the schema are read.

Spark's own Parquet reader leaves out groups too, but only in tasks that have opened the file, and
not by a row's place.  For scans of most groups it is the better one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

INDEX = "path string, row_group int, first_row long, n_rows long, bytes long, low string, high string, low_number double, high_number double"


def open_file(path: str):
    """A file for reading by ranges, of a local path or a scheme that pyarrow knows."""
    from pyarrow import fs

    where = "file://" + re.sub("^file:/+", "/", path) if path.startswith(("/", "file:")) else path
    system, name = fs.FileSystem.from_uri(where)
    return system.open_input_file(name)


def _groups_of(path: str, key: str | None, source=None) -> Iterator[tuple]:
    """The row groups of a file from its footer; a key without statistics has no range."""
    told = pq.ParquetFile(source or open_file(path)).metadata
    column = next((c for c in range(told.num_columns) if told.schema.column(c).path == key), None)
    for g in range(told.num_row_groups):
        group = told.row_group(g)
        stats = group.column(column).statistics if column is not None else None
        low, high = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
        number = isinstance(low, (int, float)) and not isinstance(low, bool)
        text = isinstance(low, str)
        yield path, g, group.num_rows, group.total_byte_size, low if text else None, high if text else None, float(low) if number else None, float(high) if number else None


def build_index(spark: SparkSession, paths: Sequence[str], key: str | None = None) -> DataFrame:
    """A row for each row group of the files, footers read in tasks; ``key`` must be a number or text.

    Numbers of 2^53 and more are held as the nearest double, which is right for pruning only.
    Files follow their paths' order.
    """
    import pandas as pd

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p in f["path"] for r in _groups_of(p, key)], columns=["path", "row_group", "n_rows", "bytes", "low", "high", "low_number", "high_number"])

    if not paths:
        return spark.createDataFrame([], INDEX)
    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    groups = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInPandas(read, "path string, row_group int, n_rows long, bytes long, low string, high string, low_number double, high_number double")
    # the first row of a file is after the files before it, of a group after those of its file
    in_file = F.sum("n_rows").over(Window.partitionBy("path").orderBy("row_group")) - F.col("n_rows")
    files = groups.groupBy("path").agg(F.sum("n_rows").alias("_rows"))
    before = files.select("path", (F.sum("_rows").over(Window.orderBy("path")) - F.col("_rows")).alias("_before"))  # one row for each file
    out = groups.withColumn("_in", in_file).join(before, "path")
    return out.select("path", "row_group", (F.col("_before") + F.col("_in")).alias("first_row"), "n_rows", "bytes", "low", "high", "low_number", "high_number")


@dataclass
class Group(InputPartition):
    """A row group, and which of its rows: from ``skip``, ``take`` of them."""

    path: str
    row_group: int
    skip: int
    take: int


class _Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path: str) -> None:
        self.file, self.bytes, self.closed = open_file(path), 0, False

    def read(self, n: int = -1) -> bytes:
        out = self.file.read(n if n is not None and n >= 0 else None)
        self.bytes += len(out)
        return out

    def seek(self, to: int, whence: int = 0) -> int:
        return self.file.seek(to, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True
        self.file.close()


class RowGroups(DataSource):
    """``spark.read.format("row_groups").schema(...).options(index=..., key=...).load()``.

    ``index`` is the path of a written index, ``key`` the column it is of, ``row_from`` and ``row_to``
    (exclusive) ask for a range of rows by place.
    """

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        first = _index_rows(self.options["index"], ["path"], None)
        if not first:
            raise ValueError("the index has no files; give a schema")
        return from_arrow_schema(pq.ParquetFile(open_file(first[0]["path"])).schema_arrow)

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(schema, dict(self.options))


def _index_rows(path: str, columns: list[str], where) -> list[dict]:
    """Rows of a written index that a pyarrow expression lets through."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri("file://" + re.sub("^file:/+", "/", path) if path.startswith(("/", "file:")) else path)
    return ds.dataset(name, filesystem=system, format="parquet").to_table(columns=columns, filter=where).to_pylist()


class RowGroupReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.wanted, self.index, self.key = schema, options["index"], options.get("key")
        self.row_from, self.row_to = int(options.get("row_from", 0)), int(options["row_to"]) if "row_to" in options else None
        self.bounds: list[tuple[str, object]] = []
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the key leave out groups; all are still applied to rows by Spark."""
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                if type(f) in names:
                    self.bounds.append((names[type(f)], f.value))
                elif isinstance(f, In):
                    self.bounds.append(("in", tuple(f.value)))
            yield f

    def _where(self):
        import pyarrow.compute as pc

        out = pc.field("n_rows") > 0
        for kind, value in self.bounds:
            values = [v for v in (value if kind == "in" else (value,)) if v is not None]
            if not values or not all(isinstance(v, str) or (isinstance(v, (int, float)) and not isinstance(v, bool)) for v in values):
                continue
            text = isinstance(values[0], str)
            low, high = (pc.field("low"), pc.field("high")) if text else (pc.field("low_number"), pc.field("high_number"))
            values = values if text else [float(v) for v in values]
            tests = []
            for v in values:
                above, below = high >= v, low <= v  # groups of the rounded bound itself stay
                tests.append({"=": above & below, "in": above & below, ">": above, ">=": above, "<": below, "<=": below}[kind])
            test = tests[0]
            for t in tests[1:]:
                test = test | t
            out = out & (test | low.is_null())
        if self.row_to is not None:
            out = out & (pc.field("first_row") < self.row_to)
        return out & (pc.field("first_row") + pc.field("n_rows") > self.row_from)

    def partitions(self) -> Sequence[Group]:
        """One for each group; where none is left, one that has no rows, as Spark asks for one."""
        rows = _index_rows(self.index, ["path", "row_group", "first_row", "n_rows"], self._where())
        out = []
        for r in sorted(rows, key=lambda r: r["first_row"]):
            end = r["first_row"] + r["n_rows"]
            a, b = max(self.row_from, r["first_row"]), end if self.row_to is None else min(self.row_to, end)
            out.append(Group(r["path"], r["row_group"], a - r["first_row"], b - a))
        return out or [Group("", 0, 0, 0)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.take:
            return
        source = _Counted(partition.path)
        try:
            # no reading ahead of what the columns need
            file = pq.ParquetFile(source, pre_buffer=False, buffer_size=0)
            there = [f.name for f in self.wanted.fields if f.name in file.schema_arrow.names]
            rows = file.read_row_group(partition.row_group, columns=there, use_threads=False).slice(partition.skip, partition.take)
            target = to_arrow_schema(self.wanted)
            columns = [rows[f.name].cast(f.type) if f.name in there else pa.nulls(len(rows), f.type) for f in target]
            yield from pa.Table.from_arrays(columns, schema=target).to_batches(1 << 16)
        finally:
            self.bytes_read += source.bytes
            source.close()


def _format(spark: SparkSession):
    spark.dataSource.register(RowGroups)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("row_groups")


def lookup(spark: SparkSession, index: str, key: str, values: Sequence, schema: StructType | str) -> DataFrame:
    """Rows whose key is one of a few values; only groups that can hold one are opened."""
    return _format(spark).schema(schema).options(index=index, key=key).load().where(F.col(key).isin(list(values)))


def row_range(spark: SparkSession, index: str, start: int, stop: int, schema: StructType | str) -> DataFrame:
    """Rows from ``start`` up to ``stop`` by their place over all files; only groups that overlap are opened."""
    if not 0 <= start <= stop:
        raise ValueError("a range of rows goes up from 0")
    return _format(spark).schema(schema).options(index=index, row_from=str(start), row_to=str(stop)).load()
