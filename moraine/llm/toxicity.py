"""Toxicity by a factorization machine over hashed terms (operator 2).

The terms of a text are its words and the first four and five bytes of longer words, in
lower case, each hashed into ``BUCKETS``.  A document has a term or has it not.  The machine
scores documents by a weight for each term and by the product of two short vectors for each
pair of terms, so that two terms together can mean what neither does alone.

The machine has the terms whose share differs between the labels, and those of pairs that
differ though their terms may not: the pairs of ``PAIRED`` terms are all counted.

All labelled documents are learned from, whole and whatever their number.  Terms and pairs of
terms are counted by Spark; the driver gets the terms chosen.  The machine is fitted by parts
of some ``PART`` documents, each making ``LOCAL`` rounds over its own, after which the means of
all parts' numbers are what the next rounds begin with.
"""

from __future__ import annotations

import copy
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import ALNUM, U64, Scratch, batch, bounded, chunks, doc_of, ids_and_text, mix, only, remainder, short_batches, text_bytes, word_hashes, words

BUCKETS = 1 << 22
#: Terms that the model may use, half of them for their own share.
TERMS = 2048
#: Documents that a part of the fit is of, and rounds until the parts meet.
PART, LOCAL = 8192, 25
#: What a state is multiplied by before it is rounded: second moments are small.
WHOLE = np.array([[2.0**50], [2.0**50], [2.0**56]])
#: Terms whose pairs are counted: those that part the documents most evenly.
PAIRED = 4096
#: How far from chance, in standard deviations, the share of a term and of a pair must be.
TERM_Z, PAIR_Z = 4, 14
PREFIXES = (4, 5)
FACTORS, ROUNDS = 4, 250
THRESHOLD = 0.3


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each term of a chunk, repeats included."""
    start, end, bounds = words(data, off, ALNUM)
    owner = doc_of(bounds)
    docs, found = [owner], [word_hashes(data, start, end, lower=True)]
    for k in PREFIXES:
        at = np.flatnonzero(end - start > k)
        docs.append(owner[at])
        found.append(mix(word_hashes(data, start[at], start[at] + k, lower=True) + U64(k)))
    return np.concatenate(docs), (np.concatenate(found) & U64(BUCKETS - 1)).astype(np.int64)


class Machine:
    """bias + sum of weights + sum over pairs of the products of their vectors."""

    def __init__(self, buckets: np.ndarray, bias: float, weight: np.ndarray, vector: np.ndarray) -> None:
        self.buckets, self.bias, self.weight, self.vector = buckets, bias, weight, vector
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self._table is None:
            self._table = np.full(BUCKETS, -1, np.int16)
            self._table[self.buckets] = np.arange(len(self.buckets))
        doc, bucket = terms(data, off)
        term = self._table[bucket]
        used = term >= 0
        both = np.unique(doc[used] * TERMS + term[used])
        doc, term = both // TERMS, both % TERMS
        y = self.bias + np.bincount(doc, self.weight[term], n)
        for f in range(self.vector.shape[1]):
            v = self.vector[term, f]
            y += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _dense(data: np.ndarray, sizes: np.ndarray, n_terms: int, kind: type) -> np.ndarray:
    """A row for each document, a column for each term: one if the document has the term; ``data`` has their places."""
    x = np.zeros((len(sizes), n_terms), kind)
    x[np.repeat(np.arange(len(sizes)), sizes), data] = 1
    return x


def _counts(rows: np.ndarray, label: np.ndarray, a: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents, and how many of label one, each of ``size`` terms from ``a`` on stands with each from ``a`` on."""
    both, positive = np.zeros((2, size, rows.shape[1] - a), np.float32)
    for d in range(0, len(rows), 1000):  # sums of ones are exact
        part = rows[d : d + 1000, a:].astype(np.float32)
        of_label = part[label[d : d + 1000] == 1]
        both += part[:, :size].T @ part
        positive += of_label[:, :size].T @ of_label
    return both, positive


def _telling(both: np.ndarray, positive: np.ndarray, a: int, seen: np.ndarray, fresh: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, p, q) of pairs of terms that stand together in documents of one label more than by chance, p from ``a`` on."""
    both, positive = both.astype(np.float64), positive.astype(np.float64)
    z = np.abs(positive - both * share) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
    later = np.arange(both.shape[1])[None, :] > np.arange(len(both))[:, None]
    # two terms that nearly always stand together are one
    apart = both < 0.9 * np.minimum(seen[None, a:], seen[a : a + len(both), None])
    i, j = np.nonzero(later & apart & (both >= 10) & (z >= PAIR_Z) & (fresh[None, a:] | fresh[a : a + len(both), None]))
    return z[i, j], i + a, j + a


def _firsts(z: np.ndarray, p: np.ndarray, q: np.ndarray, fresh: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
    """The first place of each fresh term among pairs in the order of -z, p, q."""
    out: dict[int, tuple[float, int, int, int]] = {}
    for k in np.lexsort((q, p, -z)).tolist():
        for side, t in enumerate((int(p[k]), int(q[k]))):
            if fresh[t]:
                out.setdefault(t, (-float(z[k]), int(p[k]), int(q[k]), side))
    return out


class State:
    """The numbers of a fit in one array: bias, weights and vectors, then their first and second moments."""

    def __init__(self, n_terms: int, bias: float) -> None:
        self.n_terms = n_terms
        self.all = np.zeros((3, 1 + n_terms * (1 + FACTORS)))
        self.all[0, 0] = bias
        self.all[0, 1 + n_terms :] = np.random.default_rng(7).normal(0, 0.02, n_terms * FACTORS)

    def parts(self) -> tuple[float, np.ndarray, np.ndarray]:
        now, k = self.all[0], self.n_terms
        return float(now[0]), now[1 : k + 1], now[k + 1 :].reshape(k, FACTORS)

    def descend(self, x: np.ndarray, label: np.ndarray, first: int, last: int) -> None:
        """The rounds from ``first`` to before ``last`` over all documents given."""
        now, m, s = self.all
        for step in range(first, last):
            b, w, v = self.parts()
            told = x @ np.column_stack([v, w, (v**2).sum(1)]).astype(np.float32)
            xv = told[:, :FACTORS]
            y = b + told[:, FACTORS] + 0.5 * ((xv**2).sum(1) - told[:, FACTORS + 1])
            r = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - label) / len(label)).astype(np.float32)
            back = x.T @ np.column_stack([r, r[:, None] * xv])
            g = np.concatenate([[r.sum()], back[:, 0] + 2e-4 * w, (back[:, 1:] - back[:, :1] * v + 2e-3 * v).ravel()])
            m[:] = 0.9 * m + 0.1 * g  # Adam
            s[:] = 0.99 * s + 0.01 * g * g
            now -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


def _bias(n: int, share: float) -> float:
    return float(np.log((share * n + 0.5) / (n - share * n + 0.5))) if n else -4.0


def _alone(bias: float) -> Machine:
    return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))


def fit(sets: list[np.ndarray], label: np.ndarray) -> Machine:
    """A machine from the distinct buckets of each labelled document, in memory.

    Terms in at least five documents whose share differs most between the labels (by z) are
    used, and those of pairs whose share does.  With no labelled documents, or labels all alike,
    the score is that label's share.
    """
    label = label.astype(np.float64)
    n, share = len(label), float(label.mean()) if len(label) else 0.0
    bias = _bias(n, share)
    if not n or share in (0.0, 1.0):
        return _alone(bias)
    buckets, which, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    positive = np.bincount(which, label[doc], len(buckets))
    expected = seen * share
    z = (positive - expected) / np.sqrt(expected * (1 - share) * (1 - seen / (n + 1)) + 1e-9)
    order = np.lexsort((buckets, -np.abs(z)))
    own = order[(seen[order] >= 5) & (np.abs(z[order]) >= TERM_Z)][: TERMS // 2]
    even = np.minimum(seen, n - seen)
    paired = np.lexsort((buckets, -even))[:PAIRED]
    paired = paired[even[paired] >= 10]

    def rows(pick: np.ndarray, kind: type) -> np.ndarray:
        column = np.full(len(buckets), -1)
        column[pick] = np.arange(len(pick))
        used = column[which] >= 0
        return _dense(column[which][used], np.bincount(doc[used], minlength=n), len(pick), kind)

    x, fresh = rows(paired, np.uint8), ~np.isin(paired, own)
    found = [_telling(*_counts(x, label, a, min(512, len(paired) - a)), a, seen[paired], fresh, share) for a in range(0, len(paired), 512)]
    more = _firsts(*(np.concatenate(c) for c in zip(*found, strict=True)), fresh) if found else {}
    pick = np.sort(np.concatenate([own, paired[sorted(more, key=more.get)[: TERMS - len(own)]]]))
    if not len(pick):
        return _alone(bias)
    state = State(len(pick), bias)
    state.descend(rows(pick, np.float32), label, 1, ROUNDS + 1)
    b, w, v = state.parts()
    return Machine(buckets[pick].astype(np.int64), b, w, v)


# --- the fit by Spark -----------------------------------------------------------------


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, label and the distinct buckets of every labelled document that is not held out."""
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null").where(remainder("id", 4) != 2)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = ids_and_text(docs, id_col, text_col).where("text is not null").where(remainder("doc_id", 4) != 2)
    texts = texts.join(bounded(known, 16), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("h", pa.int64()), ("buckets", pa.binary())])

    def run(batches):
        only("toxicity")
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                doc, bucket = terms(data, off)
                both = np.unique(doc * BUCKETS + bucket)
                parts = np.split((both % BUCKETS).astype(np.int32), np.searchsorted(both // BUCKETS, np.arange(1, j - i)))
                yield batch(out, [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), b.column(3).slice(i, j - i), [p.tobytes() for p in parts]])

    # repeated rows are one
    rows = texts.mapInArrow(run, "doc_id long, label int, h long, buckets binary").groupBy("doc_id").agg(F.min_by(F.struct("label", "buckets"), "h").alias("x"))
    return rows.select("doc_id", "x.label", "x.buckets")


def _terms_seen(rows: DataFrame) -> DataFrame:
    """bucket, seen and positive: in how many documents, and how many of label one, each bucket is."""
    out = pa.schema([("bucket", pa.int32()), ("seen", pa.int64()), ("positive", pa.int64())])

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(1))
            bucket, which = np.unique(data[off[0] : off[-1]].view(np.int32), return_inverse=True)
            label = np.repeat(b.column(0).to_numpy(), np.diff(off) // 4)
            yield batch(out, [bucket, np.bincount(which, minlength=len(bucket)), np.bincount(which, label, len(bucket)).astype(np.int64)])

    return rows.select("label", "buckets").mapInArrow(run, _ddl(out)).groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("positive").alias("positive"))


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _of_terms(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """doc_id, label and the places in ``buckets`` (16 bits each) of the terms that each document has."""
    out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary())])

    def run(batches):
        place = np.full(BUCKETS, -1, np.int16)
        place[buckets] = np.arange(len(buckets))
        for b in batches:
            data, off = text_bytes(b.column(2))
            at = place[data[off[0] : off[-1]].view(np.int32)]
            ends = np.concatenate([[0], np.cumsum(at >= 0)])[(off - off[0]) // 4]
            at = at[at >= 0]
            yield batch(out, [b.column(0), b.column(1), [at[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]])

    return rows.select("doc_id", "label", "buckets").mapInArrow(run, _ddl(out))


def _places(column) -> tuple[np.ndarray, np.ndarray]:
    """The places of terms of a column of ``_of_terms`` and how many each document has."""
    data, off = text_bytes(column)
    return data[off[0] : off[-1]].view(np.int16), np.diff(off) // 2


def _pair_terms(rows: DataFrame, seen: np.ndarray, fresh: np.ndarray, share: float) -> list[int]:
    """Fresh terms of the pairs that tell something, in the order of these; ``rows`` are of the terms that ``seen`` is of."""
    width = len(seen)
    out = pa.schema([("p", pa.int32()), ("both", pa.binary()), ("positive", pa.binary())])

    def count(batches, a):
        size = min(512, width - a)
        both, positive = np.zeros((2, size, width - a))
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            x, y = _counts(_dense(*_places(b.column(1)), width, np.uint8), b.column(0).to_numpy(), a, size)
            both += x
            positive += y
        if both.any():
            yield batch(out, [np.arange(a, a + size, dtype=np.int32), [r[k:].tobytes() for k, r in enumerate(both)], [r[k:].tobytes() for k, r in enumerate(positive)]])

    told = pa.schema([("t", pa.int32()), ("z", pa.float64()), ("p", pa.int32()), ("q", pa.int32()), ("side", pa.int32())])

    def choose(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        both, positive = (sum(np.frombuffer(x, np.float64) for x in t.column(c).to_pylist())[None, :] for c in ("both", "positive"))
        found = _firsts(*_telling(both, positive, p, seen, fresh, share), fresh)
        return pa.Table.from_pylist([{"t": k, "z": x[0], "p": x[1], "q": x[2], "side": x[3]} for k, x in found.items()], told)

    # each part of the pairs is counted where the documents are
    counts = [rows.select("label", "terms").mapInArrow(lambda batches, a=a: count(batches, a), _ddl(out)) for a in range(0, width, 512)]
    counted = functools.reduce(DataFrame.unionAll, counts).groupBy("p").applyInArrow(choose, _ddl(told))
    first = counted.groupBy("t").agg(F.min(F.struct("z", "p", "q", "side")).alias("at")).orderBy("at").limit(TERMS)
    return [r.t for r in first.collect()]


def _fitted(rows: DataFrame, n: int, buckets: np.ndarray, bias: float, keep: Scratch) -> Machine:
    """The machine of these terms, by rounds over parts of the documents."""
    width = len(buckets)
    own = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // PART))))
    out = pa.schema([("label", pa.binary()), ("sizes", pa.binary()), ("terms", pa.binary())])

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        places, sizes = _places(t.column("terms"))
        return pa.table([[t.column("label").to_numpy().astype(np.int32).tobytes()], [sizes.astype(np.int32).tobytes()], [places.tobytes()]], schema=out)

    # by number, or they would all be one task's
    parts = keep.put(own.repartition(min(200, -(-n // PART)), "part").groupBy("part").applyInArrow(gathered, _ddl(out)))
    state = State(width, bias)
    for first in range(1, ROUNDS + 1, LOCAL):
        last = min(first + LOCAL, ROUNDS + 1)

        def run(batches, state=state, first=first, last=last):
            total = np.zeros(state.all.size, np.int64)
            for b in batches:
                for row in b.to_pylist():
                    label = np.frombuffer(row["label"], np.int32)
                    x = _dense(np.frombuffer(row["terms"], np.int16), np.frombuffer(row["sizes"], np.int32), width, np.float32)
                    here = copy.deepcopy(state)
                    here.descend(x, label, first, last)
                    # whole numbers, whose sum is the same in any order
                    total += np.rint((here.all * WHOLE).ravel() * (len(label) / n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

        sums = parts.mapInArrow(run, "total binary").withColumn("k", F.spark_partition_id() % 8)
        sums = sums.groupBy("k").applyInArrow(lambda t: pa.table({"total": [sum(np.frombuffer(x, np.int64) for x in t.column("total").to_pylist()).tobytes()]}), "total binary")
        state.all = sum(np.frombuffer(r.total, np.int64) for r in sums.collect()).reshape(3, -1) / WHOLE
    b, w, v = state.parts()
    return Machine(buckets.astype(np.int64), b, w, v)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on all labelled documents whose crc32(id) mod 4 is not 2; null labels, ids and texts are left out.

    An id with several labels counts as labelled 1 if any is 1; of several texts of one id the
    one of the least hash counts.  Without any labelled document the score is 0.02 throughout.
    The terms are those that ``fit`` chooses, and up to ``PART`` documents the machine is that one, but for roundings.
    """
    with Scratch(docs.sparkSession) as keep:
        rows = keep.put(_labelled(docs, labels, label_col, id_col, text_col))
        n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        share = positive / n if n else 0.0
        bias = _bias(n, share)
        if not n or share in (0.0, 1.0):
            return _alone(bias)
        stats = keep.put(_terms_seen(rows))
        expected, even = F.col("seen") * F.lit(share), F.least("seen", F.lit(n) - F.col("seen"))
        z = F.abs((F.col("positive") - expected) / F.sqrt(expected * F.lit(1 - share) * (1 - F.col("seen") / F.lit(n + 1)) + F.lit(1e-9)))
        own = stats.where((F.col("seen") >= 5) & (z >= TERM_Z)).orderBy(F.desc(z), "bucket").limit(TERMS // 2).select("bucket").collect()
        paired = stats.where(even >= 10).orderBy(F.desc(even), "bucket").limit(PAIRED).select("bucket", "seen").collect()
        own, of_pairs, seen = (np.array(x, np.int64) for x in ([r.bucket for r in own], [r.bucket for r in paired], [r.seen for r in paired]))
        more = _pair_terms(keep.put(_of_terms(rows, of_pairs)), seen, ~np.isin(of_pairs, own), share) if len(paired) else []
        pick = np.sort(np.concatenate([own, of_pairs[more[: TERMS - len(own)]]]))
        return _fitted(_of_terms(rows, pick), n, pick, bias, keep) if len(pick) else _alone(bias)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) for every row of ``docs``, repeated ones included.

    Every text is read whole, whatever its length.  Null and empty texts get the score of no
    terms.  Columns other than id and text are not read, so their names do not matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # TERMS rows at most
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        only("toxicity")
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                y = model.value.scores(data, off)
                yield batch(out, [b.column(0).slice(i, j - i), y, (y >= threshold).astype(np.int32)])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, all columns kept; each row is judged where it is.

    Null and empty texts have the score of no terms.  Repeated rows all stay or all go.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    short_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        only("toxicity")
        for b in batches:
            parts = [model.value.scores(data, off) < threshold for _, _, data, off in chunks(b.column(place))]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, bool), *parts])))

    return docs.mapInArrow(run, docs.schema)
