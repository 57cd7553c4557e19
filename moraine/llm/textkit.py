"""Shared pieces of the text operators: sessions, Arrow batches, words and their hashes.

Words are found on the UTF-8 bytes of whole Arrow batches with numpy, so the cost
for a word is some tens of nanoseconds and no Python object is made for it.  Work goes
in chunks of about ``CHUNK`` bytes, so that memory follows the chunk, not the batch.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 19
_BLOCK = 1 << 16
#: Bytes of a word from which another hash is taken: sums of powers modulo 2**64 are equal for
#: some words (of Thue and Morse) of a thousand bytes.
_GIANT = 1 << 6
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir`` of the session.

    Only a session in one process, as in tests, gets a temporary folder where it names none;
    on a cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(told)
        return told
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="moraine-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which may come long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables that an operator keeps in the shared folder while it works.

    ``put`` writes a table as Parquet and reads it again; leaving the block deletes all.  What
    an operator returns must be ``cut`` before that.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = [path]
        return out

    def both(self, parts: list[DataFrame]) -> DataFrame:
        """One table of several that ``put`` made."""
        paths = [x for p in parts for x in p._scratch]
        out = self.spark.read.schema(parts[0].schema).parquet(*paths)
        out._scratch = paths
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in (x for t in tables for x in t._scratch):
            delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.base)
        release(self.spark)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever file system it is."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a table that is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, width: int, *arrays: str) -> DataFrame:
    """A table that is broadcast if its bytes, ``width`` a row and 16 an entry of its arrays, are few."""
    size = F.count("*") * F.lit(width)
    for a in arrays:
        size = size + F.lit(16) * F.coalesce(F.sum(F.size(a)), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to a Python worker: texts are long, and 10,000 of them, as is the
#: setting by itself, are held several times over on both sides.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Have fewer rows go to Python workers at a time, unless the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10000:
        spark.conf.set(name, str(BATCH_ROWS))


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own; all others stay behind."""
    short_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def thinned(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About ``most`` rows, those of the least hash of their key; all if there are no more.

    A filter, so neither a task nor the driver sees more than it keeps.
    """
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < F.lit(int(most / n * (1 << 40))))


def remainder(doc_id: str, by: int):
    """crc32 of the id as text, modulo ``by``; a null id gives null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(by)


# --- Arrow --------------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from zero) of runs of rows of about ``most`` bytes."""
    data, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


#: What operators keep in a worker from task to task.
KEPT: dict[str, dict] = {}


def only(name: str) -> None:
    """A worker that turns to an operator lets go of what it kept for others."""
    for other, kept in KEPT.items():
        if other != name and kept:
            kept.clear()
            tidy()


def tidy() -> None:
    """Give memory that a task freed back to the system: the worker goes on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


# --- words --------------------------------------------------------------------------


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], bool)


#: Bytes of words between ASCII white space.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of letters and digits; every byte of a non-ASCII character counts.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _random_table() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, key=b"byte").digest() for b in range(256)), "<u8").astype(U64)


_T = _random_table()
_B = U64(0x9E3779B97F4A7C15)
_M1, _M2, _K1, _K2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        n = _BLOCK + _GIANT + 1
        for base in (int(_B), pow(int(_B), -1, 1 << 64)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h *= _M1
    h ^= h >> U64(27)
    h *= _M2
    h ^= h >> U64(31)
    return h


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, first word of each document and the number of words at the end) of a chunk."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    own = off[:-1][off[:-1] < off[1:]]  # a word ends where its document does
    first[own] = inside[own]
    last[own[1:] - 1] = inside[own[1:] - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off, "left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (of its A-Z in lower case with ``lower``)."""
    values = _T[LOWER] if lower else _T
    out = np.empty(len(start), U64)
    up, down = _power_tables()
    size = end - start
    small = size <= _GIANT
    for k in np.flatnonzero(~small):
        word = data[start[k] : end[k]]
        out[k] = int.from_bytes(hashlib.blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    at = np.flatnonzero(small) if not small.all() else None
    s, e = (start, end) if at is None else (start[at], end[at])
    res = out if at is None else np.empty(len(s), U64)
    a = 0
    while a < len(s):
        b = int(np.searchsorted(s, s[a] + _BLOCK, "left"))
        lo, hi = int(s[a]), int(e[b - 1])
        total = np.empty(hi - lo + 1, U64)
        total[0] = 0
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=total[1:])
        h = (total[e[a:b] - lo] - total[s[a:b] - lo]) * down[s[a:b] - lo]
        res[a:b] = mix(h + (e[a:b] - s[a:b]).astype(U64) * _K1)
        a = b
    if at is not None:
        out[at] = res
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K1 + (b ^ _K2) * _K2)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words: n - k + 1 values."""
    if len(h) < k:
        return np.zeros(0, U64)
    part, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            m = len(h) - (done + size) + 1
            out = part[:m] if out is None else joined(out[:m], part[done : done + m])
            done += size
        size *= 2
        if size > k:
            return out
        part = joined(part[: len(part) - size // 2], part[size // 2 :])


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds, empty runs being zero."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
