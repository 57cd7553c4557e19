"""Substring dedup with suffix automata of reference shards (operator 5).

A window is ``window`` consecutive words.  Each window has an anchor: the run of ``ANCHOR``
words in it with the least hash (the first of equals).  Equal windows have equal anchors at
equal places, so windows are only compared where their anchors are equal.  The windows of
one anchor overlap and are kept as one segment of text.

Segments whose anchor stands nowhere else are left out, and equal segments are merged: one
stands for all.  The rest is dealt out by anchor into shards of bounded size.  A shard's
suffix automaton holds, for every substring, the smallest document that has it; the segments
of the shard are streamed through for matching statistics, which give the smallest document
of every window, and a window is removed from all documents larger than that.  The automata
are built where their shard is instead of being sent to every executor, because the
reference grows with the corpus and has no bound.

An anchor with more than ``MOST`` different segments would make an automaton of any size.  Its
windows are resolved exactly by the smallest document of each window: up to ``GATHERED``
segments by sorting the windows' hashes where the anchor is, beyond that by sums over rows of
one window, which are summed before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.textkit import U64, Scratch, batch, chunks, cut, doc_of, grams, ids_and_text, release, word_hashes, words

WINDOW, ANCHOR = 50, 18
#: Segments of an anchor beyond which its windows are resolved by sums.
MOST = 256
#: Segments of an anchor beyond which they are not gathered in one task.
GATHERED = 1 << 15
#: Words of the segments that one automaton holds.
SHARD_WORDS = 10_000
#: Parts of the segments that are shuffled one after another.
SLICES = 2


def sliding(x: np.ndarray, k: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each k consecutive values: n - k + 1 values."""
    pick = np.minimum if least else np.maximum
    size, part = 1, x
    while size * 2 <= k:
        part = pick(part[: len(part) - size], part[size:])
        size *= 2
    n = len(x) - k + 1
    return pick(part[:n], part[k - size : k - size + n])


def segments(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor, content) of each segment of a chunk.

    First windows are word numbers in the chunk; anchor and content are hashes.
    """
    none = np.zeros(0, np.int64)
    n = len(h) - window + 1
    if n <= 0:
        return none, none, none, none.view(U64), none.view(U64)
    size = np.diff(bounds)
    owner = doc_of(bounds)
    valid = np.arange(n) + window <= bounds[1:][owner[:n]]
    if not valid.any():
        return none, none, none, none.view(U64), none.view(U64)
    del size
    g = grams(h, anchor)
    span = window - anchor + 1
    # the place of the first least gram of each window: gram ranks, ties by place
    low = sliding(g, span, True)[:n]
    same = np.flatnonzero(valid)
    # the anchor of consecutive windows stays until a smaller one comes in or it leaves
    place = _first_least(g, low, span, same)
    new = np.ones(len(same), bool)
    new[1:] = (place[1:] != place[:-1]) | (np.diff(same) > 1) | (owner[same[1:]] != owner[same[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(same)))
    begin = same[first]
    # content: the hashes of the first and last window tell all words in between
    w = grams(h, window)
    content = w[begin] * U64(0x9E3779B97F4A7C15) + w[begin + count - 1] + count.astype(U64)
    return owner[begin], begin, count, g[place[first]], content


def _first_least(g: np.ndarray, low: np.ndarray, span: int, at: np.ndarray) -> np.ndarray:
    """For windows ``at`` the first place among ``span`` grams with the value low[at]."""
    # the next place at or after i whose value is the least of some window that covers it
    top = np.concatenate([np.zeros(span - 1, U64), low, np.zeros(span - 1, U64)])
    best = sliding(top, span, False)[: len(g)]
    picked = np.flatnonzero(g == best)
    j = np.searchsorted(picked, at)
    place = picked[np.minimum(j, len(picked) - 1)]
    wrong = np.flatnonzero(g[place] != low[at])
    while len(wrong):  # a picked place of a neighbouring window stands before it
        j[wrong] += 1
        place[wrong] = picked[j[wrong]]
        wrong = wrong[g[place[wrong]] != low[at[wrong]]]
    return place


class Automaton:
    """A suffix automaton of several segments, with the smallest document of every state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 62]

    def add(self, segment: list[int], doc: int) -> None:
        nxt, link, size, least = self.next, self.link, self.size, self.least
        last = 0
        for c in segment:
            to = nxt[last].get(c)
            if to is not None and size[to] == size[last] + 1:
                last = to
            elif to is not None:
                last = self._copy(last, c, to)
            else:
                new = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                least.append(1 << 62)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if size[q] == size[p] + 1 else self._copy(p, c, q)
                last = new
            if doc < least[last]:
                least[last] = doc

    def _copy(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        twin = len(nxt)
        nxt.append(nxt[q].copy())
        size.append(size[p] + 1)
        link.append(link[q])
        self.least.append(1 << 62)
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def finish(self) -> None:
        """A state's substrings also stand where longer ones do."""
        link, least = self.link, self.least
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def smallest(self, segment: list[int], window: int) -> list[int]:
        """For each window of a streamed segment the smallest document that has it, or 1 << 62."""
        nxt, link, size, least = self.next, self.link, self.size, self.least
        state, length, out = 0, 0, []
        for k, c in enumerate(segment):
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(c)
            state, length = (to, length + 1) if to is not None else (0, 0)
            if length > window:
                length = window
                while size[link[state]] >= window:
                    state = link[state]
            if k >= window - 1:
                out.append(least[state] if length >= window else 1 << 62)
        return out


def _runs(values: list[int]) -> list[tuple[int, int, int]]:
    """(first, number, value) of each run of equal values."""
    out, start = [], 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[start]:
            out.append((start, k - start, values[start]))
            start = k
    return out


_FOUND = "anchor long, content long, first int, n_windows int, smallest long"


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST, gathered: int = GATHERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, begin, n: runs of n windows from word ``begin`` that start in a smaller document too.

    ``key`` is a hash of the text, for rows that share an id.  Documents without an id are
    never smaller than others and repeat nothing.  A run may appear in parts.
    """
    with Scratch(docs.sparkSession) as keep:
        source = ids_and_text(docs, id_col, text_col).where("doc_id is not null").withColumn("key", F.xxhash64("text"))
        return cut(_repeats(source, window, anchor, most, gathered, keep))


def _segments(source: DataFrame, window: int, anchor: int) -> DataFrame:
    cols = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("begin", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64())])

    def find(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                start, end, bounds = words(data, off)
                doc, begin, n, a, content = segments(word_hashes(data, start, end), bounds, window, anchor)
                ids, keys = b.column(0).slice(i, j - i).to_numpy(), b.column(2).slice(i, j - i).to_numpy()
                yield batch(cols, [ids[doc], keys[doc], (begin - bounds[doc]).astype(np.int32), n.astype(np.int32), a.view(np.int64), content.view(np.int64)])

    return source.select("doc_id", "text", "key").mapInArrow(find, "doc_id long, key long, begin int, n int, anchor long, content long")


def _met(found: DataFrame, keep: Scratch) -> DataFrame:
    """The segments whose anchor stands more than once in the corpus; all others repeat nothing."""
    parts = []
    for s in range(SLICES):
        own = found.where(F.pmod("anchor", F.lit(SLICES)) == s)
        twice = own.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
        parts.append(keep.put(own.join(twice, "anchor").select("doc_id", "key", "begin", "n", "anchor", "content")))
        release(found.sparkSession)
    return keep.both(parts)


def _repeats(source: DataFrame, window: int, anchor: int, most: int, gathered: int, keep: Scratch) -> DataFrame:
    found = keep.put(_segments(source, window, anchor))
    met = _met(found, keep)
    keep.drop(found)
    # equal segments are one, which stands for all; the smallest document has it
    one = met.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "key", "begin", "n")).alias("at"))
    one = keep.put(one.select("anchor", "content", "at.doc_id", "at.key", "at.begin", "at.n"))
    different = one.groupBy("anchor").agg(F.count("*").alias("different"))
    wanted = one.join(different, "anchor").groupBy(F.col("doc_id").alias("asked_id"), F.col("key").alias("asked_key"))
    wanted = keep.put(wanted.agg(F.collect_list(F.struct("begin", "n", "anchor", "content", "different")).alias("wanted")))
    with_text = source.join(wanted, (F.col("doc_id") == F.col("asked_id")) & (F.col("key") == F.col("asked_key"))).select("doc_id", "text", "wanted")
    got_cols = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("different", pa.int64()), ("words", pa.binary())])

    def fetch(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                start, end, bounds = words(data, off)
                h = word_hashes(data, start, end)
                rows = []
                for k in range(j - i):
                    d, first = b.column(0)[i + k].as_py(), int(bounds[k])
                    rows += [(w["anchor"], w["content"], d, w["different"], h[first + w["begin"] : first + w["begin"] + w["n"] + window - 1].tobytes()) for w in b.column(2)[i + k].as_py()]
                yield batch(got_cols, [list(c) for c in zip(*rows, strict=True)] or [[] for _ in got_cols])

    got = keep.put(with_text.mapInArrow(fetch, "anchor long, content long, doc_id long, different long, words binary"))
    out_cols = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("n_windows", pa.int32()), ("smallest", pa.int64())])

    def resolve(batches):
        held, size, anchor_now = [], 0, None

        def flush():
            automaton, out = Automaton(), []
            for _, _, d, w in held:
                automaton.add(w, d)
            automaton.finish()
            for a, c, _, w in held:
                out += [(a, c, *run) for run in _runs(automaton.smallest(w, window))]
            return batch(out_cols, [list(c) for c in zip(*out, strict=True)] or [[] for _ in out_cols])

        for b in batches:  # rows come in the order of anchors
            for a, c, d, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if a != anchor_now and size >= SHARD_WORDS:
                    yield flush()
                    held, size = [], 0
                anchor_now = a
                w = np.frombuffer(raw, U64).tolist()
                held.append((a, c, d, w))
                size += len(w)
        if held:
            yield flush()

    few = got.where(F.col("different") <= most).select("anchor", "content", "doc_id", "words")
    by_shard = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(resolve, _FOUND)

    def gather(batches):
        held, anchor_now = [], None

        def flush():
            h = [grams(np.frombuffer(raw, U64), window) for _, _, _, raw in held]
            size = np.array([len(x) for x in h])
            doc = np.repeat(np.array([d for _, _, d, _ in held], np.int64), size)
            _, which = np.unique(np.concatenate(h), return_inverse=True)
            least = np.full(int(which.max()) + 1, 1 << 62, np.int64)
            np.minimum.at(least, which, doc)
            smallest, end = least[which], np.cumsum(size)
            out = [(a, c, *run) for (a, c, _, _), x, y in zip(held, end - size, end, strict=True) for run in _runs(smallest[x:y].tolist())]
            return batch(out_cols, [list(c) for c in zip(*out, strict=True)])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if row[0] != anchor_now and held:
                    yield flush()
                    held = []
                anchor_now = row[0]
                held.append(row)
        if held:
            yield flush()

    some = got.where(F.col("different").between(most + 1, gathered)).select("anchor", "content", "doc_id", "words")
    by_anchor = some.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(gather, _FOUND)

    def explode(batches):
        out = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("hash", pa.int64())])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                w = [grams(np.frombuffer(x.as_py(), U64), window).view(np.int64) for x in b.column(3)]
                size = np.array([len(x) for x in w])
                place = np.concatenate([np.arange(m, dtype=np.int32) for m in size])
                yield batch(out, [*(np.repeat(b.column(k).to_numpy(), size) for k in range(3)), place, np.concatenate(w)])

    many = got.where(F.col("different") > max(most, gathered)).select("anchor", "content", "doc_id", "words")
    windows = many.mapInArrow(explode, "anchor long, content long, doc_id long, first int, hash long")
    least = windows.groupBy("hash").agg(F.min("doc_id").alias("smallest"))
    by_sum = windows.join(least, "hash").select("anchor", "content", "first", F.lit(1).alias("n_windows"), "smallest")
    known = keep.put(by_shard.unionByName(by_anchor).unionByName(by_sum))
    keep.drop(got, wanted)
    release(source.sparkSession)
    return met.join(known, ["anchor", "content"]).where("smallest < doc_id").select("doc_id", "key", (F.col("begin") + F.col("first")).alias("begin"), F.col("n_windows").alias("n"))


def _cut_out(text: bytes, spans: list[tuple[int, int]], window: int) -> tuple[list[bytes], int]:
    w = text.split()  # on bytes: ASCII white space only
    if not spans:
        return w, 0
    gone = np.zeros(len(w) + 1, np.int64)
    for begin, n in spans:
        gone[begin] += 1
        gone[min(len(w), begin + n + window - 1)] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [x for x, k in zip(w, keep.tolist(), strict=True) if k], int(len(w) - keep.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, **search) -> DataFrame:
    """Every document without the words of windows that start in a smaller document too.

    Columns doc_id, n_words, n_removed and kept_text (the kept words joined by one space), or
    kept_sha256 with ``digest``.  Windows are judged on the input.  Null and empty texts have
    no words.  Rows without an id keep all their words.  Repeated rows with one id are not
    smaller than each other, so neither loses words to the other.
    """
    source = ids_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    spans = repeats(docs, window, id_col=id_col, text_col=text_col, **search)
    spans = spans.distinct().groupBy(F.col("doc_id").alias("its_id"), F.col("key").alias("its_key")).agg(F.collect_list(F.struct("begin", "n")).alias("spans"))
    spans = cut(spans)
    name = "kept_sha256" if digest else "kept_text"
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string())])

    def run(batches):
        for b in batches:
            for i, j, data, off in chunks(b.column(1)):
                starts, raw = b.column(2).slice(i, j - i), data.tobytes()
                rows = []
                for k in range(j - i):
                    own = starts[k].as_py() if starts[k].is_valid else []
                    kept, n = _cut_out(raw[off[k] : off[k + 1]], [(s["begin"], s["n"]) for s in own], window)
                    whole = b" ".join(kept)
                    rows.append((len(kept) + n, n, hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8", "replace")))
                yield batch(out, [b.column(0).slice(i, j - i), *map(list, zip(*rows, strict=True))])

    both = source.join(spans, (F.col("doc_id") == F.col("its_id")) & (F.col("key") == F.col("its_key")), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")
