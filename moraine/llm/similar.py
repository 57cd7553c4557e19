"""The search of operator 1 for similar texts: links of Jaccard 0.8 or more, for the pipeline.

A document is the set of its runs of ``shingle`` words.  Documents whose sets have a Jaccard
similarity of ``threshold`` or more are linked, and what links connect is one group.

Equal sets are merged first.  Every text has a SimHash fingerprint over the same shingles, the
shards of the vantage-point tree tell which lie within ``radius`` bits of each other, and their
sets are verified.  No bound on the distance of fingerprints holds for a similarity of 0.8
(some 10 of 64 bits on average, any number in the worst case), and over so many bits no vantage
point parts them; so what the tree leaves apart goes through a prefix filter, which loses none.

For that the shingles of a set stand in one order for the whole corpus, common ones last, and
sets that match share two among their first few.  Of the sets that share a shingle each that
the tree has not connected with the smallest of them is verified with it; then only pairs that
these links have not connected are left to verify.  So a large family of copies costs its size, not its
square, and no pair that could connect two groups is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.components import components
from moraine.llm.lines import _possible
from moraine.llm.simhash import RADIUS, fingerprint, links
from moraine.llm.textkit import Scratch, U64, batch, bounded, chunks, cut, grams, ids_and_text, only, release, text_bytes, word_hashes, words

THRESHOLD, SHINGLE = 0.8, 5
#: Counters of shingles by hash, which tell common ones.
COUNTERS = 1 << 18
_TOP = U64(46)
#: Parts of the shingles that are shuffled one after another.
SLICES = 2


def _sets(column, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its different shingles as sorted hashes) for every row; all words are one shingle if there are fewer."""
    for i, j, data, off in chunks(column):
        start, end, bounds = words(data, off)
        h = word_hashes(data, start, end, lower=True)
        for k in range(i, j):
            own = h[bounds[k - i] : bounds[k - i + 1]]
            yield k, np.unique(grams(own, min(shingle, max(1, len(own)))))


def _key(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def commonness(source: DataFrame, shingle: int) -> np.ndarray:
    """For each counter how many sets have its shingles, in steps of a quarter of a doubling."""
    out = pa.schema([("counter", pa.int32()), ("n", pa.int64())])

    def run(batches):
        only("similar")
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for b in batches:
            for _, own in _sets(b.column(1), shingle):
                held.append(own >> _TOP)
                size += len(own)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield batch(out, [at.astype(np.int32), total[at]])

    rows = source.mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    steps = np.zeros(COUNTERS, np.uint8)
    steps[rows.column("counter").to_numpy()] = 4 * np.log2(rows.column("n").to_numpy() + 1)
    return steps


def _prefixes(source: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, key and n (of its set), prefix, the first shingles of the set, and fp, the text's fingerprint, for every row."""
    steps = source.sparkSession.sparkContext.broadcast(commonness(source, shingle))  # COUNTERS bytes
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("fp", pa.int64())])

    def run(batches):
        only("similar")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own_rows = b.slice(at, 256)
                keys, sizes, first = [], [], []
                for _, own in _sets(own_rows.column(1), shingle):
                    n = len(own)
                    keys.append(_key(own))
                    sizes.append(n)
                    # a smaller set matches none but its equals, even if the other has just one more
                    m = min(n, n - int(np.ceil(threshold * n - 1e-9)) + 2) if n / (n + 1) >= threshold - 1e-9 else 0
                    order = np.argsort(steps.value[(own >> _TOP).astype(np.int64)], kind="stable")[:m]
                    first.append(own[order].view(np.int64))
                data, off = text_bytes(own_rows.column(1))
                fp = np.fromiter((fingerprint(data[x:y].tobytes(), shingle) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), U64, own_rows.num_rows)
                yield batch(out, [own_rows.column(0), keys, sizes, pa.array(first, out.field(3).type), fp.view(np.int64)])

    return source.mapInArrow(run, "doc_id long, key long, n int, prefix array<long>, fp long")


def _verified(pairs: DataFrame, sets: DataFrame, source: DataFrame, shingle: int, threshold: float, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of keys whose sets match; whole sets are made from the texts of the documents asked for."""
    out = pa.schema([("key", pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches):
        only("similar")
        for b in batches:
            held, size = [], 0
            for _, own in _sets(b.column(1), shingle):
                held.append((_key(own), own.view(np.int64)))
                size += len(own)
                if size > 1 << 18:
                    yield batch(out, [pa.array([k for k, _ in held], pa.int64()), pa.array([w for _, w in held], out.field(1).type)])
                    held, size = [], 0
            if held:
                yield batch(out, [pa.array([k for k, _ in held], pa.int64()), pa.array([w for _, w in held], out.field(1).type)])

    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    asked = keep.put(asked.join(sets, "key").select(F.col("least").alias("asked")))
    texts = source.join(bounded(asked, 16), F.col("doc_id") == F.col("asked")).select("doc_id", "text")
    whole = keep.put(texts.mapInArrow(run, "key long, words array<long>"))
    wa, wb = (whole.select(F.col("key").alias(k), F.col("words").alias(f"w{k}")) for k in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    near = pairs.join(wa, "a").join(wb, "b").where(both / (F.size("wa") + F.size("wb") - both) >= threshold - 1e-9)
    found = keep.put(near.select("a", "b").distinct())
    keep.drop(whole, asked)
    release(source.sparkSession)
    return found


def _meetings(firsts: DataFrame, keep: Scratch) -> DataFrame:
    """w, least, key, n and p: the shingles w, at place p, that more than one set has."""
    every = firsts.select("key", "n", F.posexplode("prefix").alias("p", "w"))
    parts = []
    for s in range(SLICES):
        own = every.where(F.pmod("w", F.lit(SLICES)) == s)
        met = own.groupBy("w").agg(F.count("*").alias("times"), F.min("key").alias("least")).where("times > 1").drop("times")
        parts.append(keep.put(own.join(met, "w").select("w", "least", "key", "n", "p")))
        release(firsts.sparkSession)
    return keep.both(parts)


def _close(rows: DataFrame, radius: int, keep: Scratch, **tree) -> DataFrame:
    """Pairs (a, b) of keys, a < b, of sets whose texts have fingerprints that the vantage-point tree links.

    The least key of a fingerprint stands for it, and is in a pair with every other one.
    """
    seen = keep.put(rows.groupBy("fp").agg(F.min("key").alias("lead")))
    side = lambda c: seen.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}"))
    near = links(seen.select("fp"), radius, **tree).where("a <> b").distinct().join(side("a"), "a").join(side("b"), "b").select("lead_a", "lead_b")
    near = near.unionByName(rows.join(seen, "fp").select(F.col("lead").alias("lead_a"), F.col("key").alias("lead_b")))
    return keep.put(near.where("lead_a <> lead_b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b")).distinct())


def _links(firsts: DataFrame, close: DataFrame, sets: DataFrame, source: DataFrame, shingle: int, threshold: float, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of keys of matching sets that connect all sets which matches connect; ``close`` are verified first."""
    found = _verified(close, sets, source, shingle, threshold, keep)
    known = components(found).select("node", F.col("root").alias("its"))
    met = _meetings(firsts, keep)
    lead = met.where("key = least").select("w", F.col("n").alias("ln"), F.col("p").alias("lp"))
    possible = lambda an, ap, bn, bp: _possible(F.col(an), F.col(bn), F.col(ap), F.col(bp), threshold)
    first = met.join(lead, "w").where((F.col("key") != F.col("least")) & possible("ln", "lp", "n", "p"))
    first = first.groupBy(F.col("least").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
    for c in "ab":
        first = first.join(bounded(known.select(F.col("node").alias(c), F.col("its").alias(f"root_{c}")), 24), c, "left")
    first = first.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")  # others are connected
    first = keep.put(first.join(close, ["a", "b"], "left_anti"))
    found = keep.put(found.unionByName(_verified(first, sets, source, shingle, threshold, keep)))
    roots = components(found).select(F.col("node"), F.col("root").alias("its"))
    rooted = met.drop("least").join(bounded(roots, 24), F.col("key") == F.col("node"), "left").select("key", "n", "p", "w", F.coalesce("its", "key").alias("root"))
    apart = rooted.groupBy("w").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("w")
    rooted = keep.put(rooted.join(apart, "w"))
    keep.drop(met)
    a, b = (rooted.select("w", *(F.col(c).alias(f"{side}{c}") for c in ("key", "n", "p", "root"))) for side in "ab")
    shared = a.join(b, "w").where((F.col("akey") < F.col("bkey")) & (F.col("aroot") != F.col("broot")) & possible("an", "ap", "bn", "bp"))
    rest = shared.groupBy(F.col("akey").alias("a"), F.col("bkey").alias("b")).agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
    rest = keep.put(rest.join(first.unionByName(close), ["a", "b"], "left_anti"))
    return found.unionByName(_verified(rest, sets, source, shingle, threshold, keep))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its group, for every row of ``docs``.

    A-Z are lower-cased; words stand between ASCII white space.  Texts without words, null
    ones too, are one group.  A row without an id is in the group of its equals, links nothing
    else and never names a group (component_id is null if all its rows have no id).  Rows that repeat
    give as many rows; rows of one id and different texts are sets of their own.
    """
    with Scratch(docs.sparkSession) as keep:
        source = ids_and_text(docs, id_col, text_col)
        rows = keep.put(_prefixes(source, shingle, threshold))
        sets = keep.put(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
        # one row of each set
        repeated = sets.where("copies > 1").select(F.col("key").alias("key_"), "least")
        firsts = rows.where("size(prefix) > 0").join(bounded(repeated, 24), F.col("key") == F.col("key_"), "left").where("key_ is null or doc_id = least").select("key", "n", "prefix")
        close = _close(rows.select("fp", "key"), radius, keep, **tree)
        found = components(_links(firsts, close, sets, source, shingle, threshold, keep))
        known = sets.join(found, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
        known = keep.put(known)
        roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
        known = known.join(roots, "root").select(F.col("key").alias("known_key"), "component_id")
        return cut(rows.join(known, F.col("key") == F.col("known_key")).select("doc_id", "component_id"))
