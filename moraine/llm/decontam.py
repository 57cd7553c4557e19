"""Benchmark decontamination by suffix arrays of training shards (operator 10).

Every chunk of documents is a shard.  Its suffix array sorts the places where a test text
could begin to match, and every test suffix is searched in it by bisection, all test
suffixes at once.  What is found is checked again on the bytes.  No document leaves its
partition, so nothing is shuffled while the benchmark fits in one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import ALNUM, LOWER, U64, batch, chunks, doc_of, ids_and_text, only, short_batches, word_hashes, words

WINDOW = 10
#: Bytes of the table of test suffixes that is broadcast at a time; a larger benchmark goes in several blocks.
BLOCK_BYTES = 64 << 20
#: Bytes of that table for each word, beside the word's own.
_WORD_BYTES = 40


def _runs(ids: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A number for the run of ``k`` words at every place, equal for equal runs; a run stops where its item ends.

    Numbers of 1, 2, 4, ... words come from those of half as many, and ``k`` words from these.
    """
    at, most = np.arange(len(ids)), len(ids) + 2

    def then(x: np.ndarray, y: np.ndarray, by: int) -> np.ndarray:
        after = np.zeros(len(y), np.int64)
        after[: max(0, len(y) - by)] = y[by:]
        after[at + by >= ends] = 0
        return np.unique(x * most + after, return_inverse=True)[1].astype(np.int64) + 1

    part, size, out, done = ids.astype(np.int64) + 1, 1, None, 0
    while True:
        if k & size:
            out = part if out is None else then(out, part, done)
            done += size
        size *= 2
        if size > k:
            return out
        part = then(part, part, size // 2)


class TestSuffixes:
    """The windows of a block of items: the first words of every test suffix, each once, by the hash of its first word.

    Flat arrays, some 7 times the text: ``text`` has all words of the block in lower case with a
    space behind each, ``at`` where each begins, ``h`` their hashes.  A window is its ``first`` word
    and its ``size``; ``heads`` has the hashes of the first words.  It stands at the places ``item`` and
    ``offset`` from its entry of ``bounds`` to the next one; ``names`` are the items' ids.
    """

    __test__ = False

    def __init__(self, rows: list[tuple[str, str]], window: int) -> None:
        self.window = window
        self.names = sorted({name for name, _ in rows})
        number = {name: k for k, name in enumerate(self.names)}
        own = np.array([number[name] for name, _ in rows], np.int32)
        text, sizes, hashes, counts = [], [], [], []
        for _, _, data, off in chunks(pa.array([t for _, t in rows], pa.large_string())):
            start, end, bounds = words(data, off, ALNUM)
            text.append(LOWER[data][ALNUM[data]])
            sizes.append(end - start)
            hashes.append(word_hashes(data, start, end, lower=True))
            counts.append(np.diff(bounds))
        join = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
        letters, length, count = join(text, np.uint8), join(sizes, np.int64), join(counts, np.int64)
        self.h = join(hashes, U64)
        n = len(length)
        past = np.concatenate([[0], np.cumsum(length)])
        # words by their bytes, not their hashes: equal hashes of different words stay two windows
        ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(past), pa.py_buffer(letters)]).dictionary_encode().indices.to_numpy()
        self.at = (past + np.arange(n + 1)).astype(np.int32)
        self.text = np.full(int(self.at[-1]), 0x20, np.uint8)
        inside = np.ones(len(self.text), bool)
        inside[self.at[1:] - 1] = False
        self.text[inside] = letters
        begin = np.concatenate([[0], np.cumsum(count)])
        item = np.repeat(np.arange(len(count)), count)
        size = np.minimum(count, window)[item]
        where = np.flatnonzero(np.arange(n) + size <= begin[1:][item])
        _, some, group = np.unique(_runs(ids, begin[1:][item], window)[where], return_index=True, return_inverse=True)
        order = np.argsort(self.h[where[some]], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.first = where[some][order].astype(np.int32)
        self.size = size[self.first].astype(np.int32)
        self.heads = self.h[self.first]
        by = np.argsort(back[group], kind="stable")
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(order))[order])]).astype(np.int32)
        self.item = own[item[where[by]]]
        self.offset = (where[by] - begin[item[where[by]]]).astype(np.int32)
        self.vocabulary = np.unique(self.h)
        self.shortest = int(self.size.min()) if len(self.size) else 0

    def key(self, t: int) -> bytes:
        """The words of a window, one space between them."""
        a = int(self.first[t])
        return self.text[self.at[a] : self.at[a + int(self.size[t])] - 1].tobytes()

    def places(self, t: int) -> list[tuple[int, int]]:
        """(number of the item, word) wherever a window stands."""
        a, b = self.bounds[t : t + 2]
        return list(zip(self.item[a:b].tolist(), self.offset[a:b].tolist(), strict=True))

    def beginning(self, heads: np.ndarray) -> np.ndarray:
        """The windows whose first word has one of these hashes; all others are found nowhere."""
        lo, hi = np.searchsorted(self.heads, heads, "left"), np.searchsorted(self.heads, heads, "right")
        return _ranges(lo, hi)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers from each of ``lo`` to below its ``hi``, one range after the other."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def suffix_array(h: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in the order of their next ``depth`` words.

    Ranks of 1, 2, 4, ... words come from the ranks of half as many (prefix doubling).
    """
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64) + 1
    size = 1
    while size < depth:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - size)] = rank[size:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        size *= 2
    return at[np.argsort(rank[at], kind="stable")]


def search(h: np.ndarray, sa: np.ndarray, tests: TestSuffixes, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the test suffixes ``ask`` the range of the suffix array whose places begin with each.

    Words compare as numbers; beyond the shard's end stands a word less than all.
    """
    padded = np.concatenate([h, np.zeros(tests.window, U64)])
    first, size = tests.first[ask].astype(np.int64), tests.size[ask]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(ask), np.int64), np.full(len(ask), len(sa), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = sa[np.minimum(mid, len(sa) - 1)]
            less = np.zeros(len(mid), bool)
            equal = np.ones(len(mid), bool)
            for j in range(tests.window):
                live = equal & (j < size)
                w, t = padded[at + j], tests.h[np.minimum(first + j, len(tests.h) - 1)]
                less |= live & (w < t)
                equal &= ~live | (w == t)
            go = open_ & (less | equal if upper else less)
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    return bound(False), bound(True)


def _places(h: np.ndarray, bounds: np.ndarray, tests: TestSuffixes) -> np.ndarray:
    """Places where a match can begin: a run of words of the benchmark that is long enough."""
    known = tests.vocabulary[np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)] == h
    breaks = np.zeros(len(h) + 1, bool)
    breaks[bounds] = True
    stop = np.flatnonzero(breaks[:-1] | ~known)  # a run ends before an unknown word or a new document
    stop = np.append(stop, len(h))
    at = np.flatnonzero(known)
    return at[stop[np.searchsorted(stop, at, "right")] - at >= tests.shortest]


def match_chunk(data: np.ndarray, off: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of documents in words, first word of each hit, its test suffix)."""
    start, end, bounds = words(data, off, ALNUM)
    none = np.zeros(0, np.int64)
    if not len(start) or not len(tests.first):
        return bounds, none, none
    h = word_hashes(data, start, end, lower=True)
    at = _places(h, bounds, tests)
    if not len(at):
        return bounds, none, none
    # the shard: the words that any of these places can reach
    reach = np.unique(np.minimum(at[:, None] + np.arange(tests.window)[None, :], len(h) - 1))
    where = np.searchsorted(reach, at)
    gap = np.ones(len(reach), bool)
    gap[1:] = np.diff(reach) > 1
    # between runs stands a word that no test has, so that no match goes across
    shift = np.cumsum(gap)
    shard = np.zeros(len(reach) + int(shift[-1]) if len(shift) else 0, U64)
    shard[np.arange(len(reach)) + shift - 1] = h[reach]
    place = where + shift[where] - 1
    back = np.zeros(len(shard), np.int64)
    back[np.arange(len(reach)) + shift - 1] = reach
    sa = suffix_array(shard, place, tests.window)
    ask = tests.beginning(np.unique(shard[place]))
    lo, hi = search(shard, sa, tests, ask)
    test = np.repeat(ask, hi - lo)
    hit = back[sa[_ranges(lo, hi)]]
    low = LOWER[data]
    owner = doc_of(bounds)
    good = np.zeros(len(test), bool)
    for k, (s, t) in enumerate(zip(hit.tolist(), test.tolist(), strict=True)):
        e = s + int(tests.size[t])
        good[k] = e <= len(start) and owner[s] == owner[e - 1] and b" ".join(low[start[x] : end[x]].tobytes() for x in range(s, e)) == tests.key(t)
    return bounds, hit[good], test[good]


def _report(spans: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """(words covered, maximal spans) of spans of words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sum(b - a for a, b in out), [(a, b) for a, b in out]


FOUND = "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>, longest long"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


#: The same between two passes, which needs the text again.
PASSED = FOUND.replace("doc_id long, ", "doc_id long, text string, ")
_PASSED = pa.schema([_FOUND.field(0), ("text", pa.string()), *(_FOUND.field(k) for k in range(1, len(_FOUND)))])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[Broadcast]:
    """Tables of test suffixes of ``most`` bytes or so, made one after another from items dealt by the hash of their id."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).where("item is not null and text is not null")
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + _WORD_BYTES * n_words)).first()[0] or 0
    n = max(1, -(-int(total) // most))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(TestSuffixes([(r[0], r[1]) for r in own.toLocalIterator()], window))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, maximal spans of hit words, the items hit and the longest verbatim match in words.

    One row per row of ``docs``, repeated ones included; a null text has no words.  Items that
    are null, or have no words, match nothing.  A benchmark of several blocks is one pass for
    each, which adds to what the passes before it found; no row leaves its place.
    """
    source = ids_and_text(docs, id_col, text_col)
    tables = list(_blocks(benchmark, item_col, item_text_col, window, block_bytes))
    for k, table in enumerate(tables):
        last = k == len(tables) - 1

        def run(batches, table=table, first=k == 0, last=last):
            only("decontam")
            tests = table.value
            for b in batches:
                for i, j, data, off in chunks(b.column(1)):
                    bounds, hit, test = match_chunk(data, off, tests)
                    by_doc: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    for d, s, t in zip((np.searchsorted(bounds, hit, "right") - 1).tolist(), hit.tolist(), test.tolist(), strict=True):
                        by_doc[d].append((s - int(bounds[d]), t))
                    out = []
                    for d in range(j - i):
                        before = ([], [], 0) if first else ([(x["begin"], x["end"]) for x in b.column(3)[i + d].as_py()], b.column(4)[i + d].as_py(), b.column(5)[i + d].as_py())
                        spans = _report([*before[0], *((s, s + int(tests.size[t])) for s, t in by_doc.get(d, ()))])[1]
                        names = sorted({*before[1], *(tests.names[x] for _, t in by_doc.get(d, ()) for x, _ in tests.places(t))})
                        out.append(([{"begin": a, "end": e} for a, e in spans], names, max(before[2], _longest(by_doc.get(d, ()), tests))))
                    spans, names, longest = zip(*out, strict=True)
                    found = [np.diff(bounds), list(spans), list(names), list(longest)]
                    text = [] if last else [b.column(1).slice(i, j - i)]
                    yield batch(_FOUND if last else _PASSED, [b.column(0).slice(i, j - i), *text, *found])

        source = source.mapInArrow(run, FOUND if last else PASSED)
    return source


def _longest(hits, tests: TestSuffixes) -> int:
    """Words of the longest run that a document and one item have in common."""
    lines: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for s, t in hits:
        for item, place in tests.places(t):
            lines[item, s - place].append((s, s + int(tests.size[t])))
    return max((b - a for spans in lines.values() for a, b in _report(spans)[1]), default=0)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """A row for every row of ``docs``: how much of it stands in the benchmark, and where.

    doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words of the
    longest run that a text and one item share) and places (begin:end of the maximal runs of
    hit words, comma-joined, ends exclusive).  Null and empty texts have no words and are
    clean, as is every text if the benchmark is empty.
    """
    found = matches(docs, benchmark, window, **columns)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    places = F.transform("spans", lambda x: F.concat_ws(":", x["begin"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("longest").alias("longest_match"), F.concat_ws(",", places).alias("places"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text shares no window with the benchmark, all columns kept.

    Every row is judged by its own text, where it is: nothing is shuffled, and a benchmark of
    several blocks is one pass for each.  Null and empty texts stay.
    """
    short_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    for table in list(_blocks(benchmark, item_col, item_text_col, window, block_bytes)):

        def run(batches, table=table):
            only("decontam")
            tests = table.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for i, _, data, off in chunks(b.column(place)):
                    bounds, hit, _ = match_chunk(data, off, tests)
                    clean[i + np.searchsorted(bounds, hit, "right") - 1] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
