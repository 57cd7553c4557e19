"""Quality rules by gradient-boosted trees over document statistics (operator 3).

A document becomes a row of statistics, all from its whole text.  Trees are grown on binned
statistics with logistic loss; where a statistic is constrained, a tree may only lower the
quality as it rises.  All trees are flattened into arrays of nodes and every document walks
all trees at once.  The fit sees at most ``LABELLED`` labelled documents, those of the least
hash of their id; everything else covers all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import SPACED, U64, batch, chunks, cut, doc_of, grams, ids_and_text, mix, per_doc, remainder, thinned, word_hashes, words

LABELLED = 8000
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.2
THRESHOLD = 0.5
REPEAT = 5
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_LINE = np.arange(256) != 10
_IS = {name: np.array([f(chr(b)) and b < 128 for b in range(256)]) for name, f in (("digit", str.isdigit), ("upper", str.isupper), ("lower", str.islower), ("stop", lambda c: c in "!?"), ("point", lambda c: c in ".,;:"))}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics of the trees; -1: quality may only fall as it rises, 0: free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeats": -1, "digits": 0, "capitals": -1, "exclamations": -1, "points_per_word": 0, "non_ascii": 0,
    "words_per_line": 0, "distinct": 0, "one_letter": 0, "log_lines": 0,
}


def repeated(h: np.ndarray, bounds: np.ndarray, k: int = REPEAT) -> np.ndarray:
    """For each document the words in windows of k words that stand in it twice or more."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    owner = doc_of(bounds)
    inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
    g = mix(grams(h, k)[inside] ^ mix(owner[inside].astype(U64)))
    _, which, seen = np.unique(g, return_inverse=True, return_counts=True)
    cover = np.zeros(len(h) + 1, np.int64)
    at = inside[seen[which] > 1]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return per_doc((np.cumsum(cover)[:-1] > 0).astype(np.int64), bounds)


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, statistics of the trees), one row for each document of a chunk."""
    start, end, bounds = words(data, off)
    h = word_hashes(data, start, end)
    heads = (data & 0xC0) != 0x80  # first bytes of characters
    inside = SPACED[data]
    n = np.diff(bounds)
    count = lambda mask: per_doc(mask.astype(np.int64), off)
    ls, le, lb = words(data, off, _LINE)
    lh = word_hashes(data, ls, le)
    with_word = np.searchsorted(start, le) > np.searchsorted(start, ls)  # words start in the line
    lo = doc_of(lb)[with_word]
    _, first = np.unique(mix(lh[with_word] ^ mix(lo.astype(U64))), return_index=True)
    lines = np.bincount(lo, minlength=len(n))
    dup = lines - np.bincount(lo[first], minlength=len(n))
    owner = doc_of(bounds)
    _, first = np.unique(mix(h ^ mix(owner.astype(U64))), return_index=True)
    distinct = np.bincount(owner[first], minlength=len(n))
    chars, symbols, rep = count(heads & inside), count(_SYMBOLS[data]), repeated(h, bounds)
    base = np.stack([n, chars, symbols, dup, rep], 1)
    some, someline, somechar = np.maximum(n, 1), np.maximum(lines, 1), np.maximum(chars, 1)
    letters = np.maximum(count(_IS["upper"][data]) + count(_IS["lower"][data]), 1)
    x = [
        np.log1p(n), chars / some, symbols / some, dup / someline, rep / some, count(_IS["digit"][data]) / somechar, count(_IS["upper"][data]) / letters, count(_IS["stop"][data]) / some, count(_IS["point"][data]) / some,
        count(data >= 0xC0) / somechar, n / someline, distinct / some, per_doc((end - start == 1).astype(np.int64), bounds) / some, np.log1p(lines),
    ]
    return base, np.stack(x, 1)


class Forest:
    """Trees as flat arrays: a leaf is a node that leads to itself."""

    def __init__(self, feature: list, limit: list, left: list, right: list, value: list, roots: list, bias: float) -> None:
        self.feature, self.left, self.right, self.roots = (np.array(a, np.int32) for a in (feature, left, right, roots))
        self.limit, self.value, self.bias = np.array(limit, np.float64), np.array(value, np.float64), bias

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.bias)
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, constraints: list[int] | None = None, trees: int = TREES) -> Forest:
    """Boosted trees; with no rows, or labels all alike, a forest of no trees with that label's share."""
    n = len(label)
    label = label.astype(np.float64)
    share = float(label.mean()) if n else 1.0
    bias = float(np.log((share * n + 0.5) / (n - share * n + 0.5)))
    nodes: tuple[list, ...] = ([], [], [], [], [])
    feature, limit, left, right, value = nodes
    roots: list[int] = []
    constraints = constraints or [0] * x.shape[1]
    if n and 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        score = np.full(n, bias)

        def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
            here = len(feature)
            total_g, total_h = g[at].sum(), h[at].sum()
            own = float(np.clip(-total_g / (total_h + 1.0), low, high))
            for a, v in zip(nodes, (0, np.inf, here, here, RATE * own), strict=True):
                a.append(v)
            best, choice = 1e-3, None
            if depth < DEPTH and len(at) >= 20:
                for f, e in enumerate(edges):
                    gs = np.cumsum(np.bincount(binned[at, f], g[at], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[at, f], h[at], len(e) + 1))[:-1]
                    rg, rh = total_g - gs, total_h - hs
                    lv, rv = np.clip(-gs / (hs + 1), low, high), np.clip(-rg / (rh + 1), low, high)
                    gain = -(gs * lv + 0.5 * (hs + 1) * lv**2) - (rg * rv + 0.5 * (rh + 1) * rv**2) + (total_g * own + 0.5 * (total_h + 1) * own**2)
                    bad = (hs < 1) | (rh < 1) | (constraints[f] * (rv - lv) < 0)
                    gain[bad] = -1
                    if len(gain) and gain.max() > best:
                        k = int(gain.argmax())
                        best, choice = float(gain[k]), (f, k, float(lv[k]), float(rv[k]))
            if choice is not None:
                f, k, lv, rv = choice
                goes = binned[at, f] <= k
                middle = (lv + rv) / 2
                bounds = ((low, high), (low, high)) if not constraints[f] else ((low, middle), (middle, high)) if constraints[f] > 0 else ((middle, high), (low, middle))
                feature[here], limit[here], value[here] = f, float(edges[f][k]), 0.0
                left[here] = grow(at[goes], g, h, depth + 1, *bounds[0])
                right[here] = grow(at[~goes], g, h, depth + 1, *bounds[1])
            return here

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            first = len(feature)
            roots.append(grow(np.arange(n), p - label, p * (1 - p), 0, -np.inf, np.inf))
            one = Forest(*(a[first:] for a in (feature, limit)), [v - first for v in left[first:]], [v - first for v in right[first:]], value[first:], [0], 0.0)
            score += one.raw(x)
    return Forest(*nodes, roots, bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on labelled documents whose crc32(id) mod 4 is not 2; null labels and ids are left out.

    An id with several labels has the greatest; of several texts of one id that of the least
    hash counts.  Without any labelled document every text that passes the base is kept.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null").where(remainder("id", 4) != 2)
    known = thinned(cut(known.groupBy("id").agg(F.max("label").alias("label"))), most, "id")  # a bounded table
    texts = ids_and_text(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("h", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                yield batch(out, [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), b.column(3).slice(i, j - i), list(statistics(data, off)[1])])

    # repeated rows are one before they reach the driver
    rows = texts.mapInArrow(run, "doc_id long, label int, h long, x array<double>").groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), F.coalesce("h", F.lit(0))).alias("x")).select("doc_id", "x.label", "x.x").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    return fit(x[order], rows.column("label").to_numpy()[order], list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score for every row of ``docs``, repeated ones included.

    A null or empty text has no words, so it fails the base and is not kept.  A text of any
    length is read whole.  Words and lines are equal if their 64-bit hashes are.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)  # TREES * 2 ** (DEPTH + 1) nodes at most
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                base, x = statistics(data, off)
                y = model.value.scores(x)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                yield batch(out, [b.column(0).slice(i, j - i), *base.T, failed, ~failed & (y >= threshold), y])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double")
