"""SimHash near-duplicates over shards of a vantage-point tree (operator 1).

A bounded sample of distinct fingerprints gives the upper vantage-point tree.  Every node
has a vantage point and a radius m: fingerprints at distance m or less go inside, those
further out go outside.  By the triangle bound, two fingerprints within ``radius`` bits of
each other that are parted by a node have distances from its vantage point that differ by
``radius`` at most; so it suffices that those inside with a distance over m - radius go
outside as well.  Each leaf is a shard; in it the tree goes on until a few hundred
fingerprints are left, which are compared exactly.

Where many fingerprints crowd in a ball of a few bits, no vantage point parts them.  Such
crowds take another exact way: two fingerprints within two bits share one that is at most
one bit from either, so each sends out itself and its 64 neighbours and those that meet are
linked.  That grows in proportion to the crowd.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.components import components
from moraine.llm.textkit import U64, batch, bounded, cut, ids_and_text, text_bytes, thinned

RADIUS = 2
#: Distinct fingerprints that the driver sees to lay out the upper tree: these at least, one in
#: so many, and so many (32 MB) at most.  With them the leaves stay small as the corpus grows.
SAMPLE, ONE_IN, MOST_SEEN = 1 << 16, 512, 1 << 22
#: Fingerprints aimed at in a shard, and the most shards.
SHARD, MOST_SHARDS = 1024, 1 << 17
#: Fingerprints that are compared each with each.
SMALL = 256
_BITS = U64(1) << np.arange(64, dtype=U64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text by the definition of ``fingerprints``."""
    w = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    if len(w) < shingle:
        return _hash(b" ".join(w))
    n = len(w) - shingle + 1
    count = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        m = min(1 << 16, n - k)
        runs = zip(*(w[k + j : k + j + m] for j in range(shingle)), strict=True)
        h = np.fromiter(map(_hash, map(b" ".join, runs)), U64, m)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * count > n].sum(dtype=U64))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``fp``, the 64 bits of the SimHash as a signed number, for every whole text.

    A-Z are lower-cased; words stand between ASCII white space; shingles are runs of words,
    repeats included, joined by a space (all words if there are fewer).  A bit is set if it is
    in over half the XXH64 hashes (seed 42).  Null and empty texts have fingerprint zero.
    """
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            data, off = text_bytes(b.column(1))
            fp = np.fromiter((fingerprint(data[x:y].tobytes(), shingle) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), U64, b.num_rows)
            yield batch(out, [b.column(0), fp.view(np.int64)])

    return ids_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# --- the tree -----------------------------------------------------------------------


def parted(x: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part ``x`` well, or None if none is found.

    Of some points of x and some of their distances, the one with the smallest larger side
    counts, those that go to both sides included.
    """
    best, choice = 0.85 * len(x), None
    for v in x[rng.integers(0, len(x), 8)]:
        n = np.bincount(np.bitwise_count(x ^ v), minlength=65)
        inside = np.cumsum(n)
        outside = len(x) - np.concatenate([np.zeros(radius, n.dtype), inside[:-radius] if radius else inside])
        for m in range(64):
            size = max(inside[m], outside[m])
            # what goes to both sides is work done twice
            if inside[m] and outside[m] and size + 0.5 * (inside[m] + outside[m] - len(x)) < best:
                best, choice = size + 0.5 * (inside[m] + outside[m] - len(x)), (v, m)
    return choice


class Tree:
    """The upper tree as arrays; leaf numbers are at or over 0, crowds are -1."""

    def __init__(self, sample: np.ndarray, total: int, shard: int = SHARD, most: int = MOST_SHARDS, radius: int = RADIUS) -> None:
        self.radius = radius
        rng = np.random.default_rng(1)
        want = max(shard, -(-total // most))
        share = total / max(1, len(sample))
        self.point: list[np.uint64] = []
        self.limit: list[int] = []
        self.child: list[list[int]] = []  # a node's number, or ~leaf; crowds are None
        self.leaves = 0
        todo = [(sample, -1, 0)]
        self.root: int | None = ~0
        while todo:
            x, parent, side = todo.pop()
            choice = parted(x, radius, rng) if len(x) * share > want and len(x) >= 64 else None
            if choice is not None:
                v, m = choice
                d = np.bitwise_count(x ^ v)
                here = len(self.point)
                self.point.append(v)
                self.limit.append(m)
                self.child.append([0, 0])
                todo += [(x[d <= m], here, 0), (x[d > m - radius], here, 1)]
            elif len(x) * share > 4 * want and len(x) >= 64 and radius == 2:
                here = None
            else:
                here, self.leaves = ~self.leaves, self.leaves + 1
            if parent < 0:
                self.root = here
            else:
                self.child[parent][side] = here

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of x, its leaf) for each leaf it belongs in, and which of x are in crowds."""
        which, leaf, crowd = [], [], []
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node is None:
                crowd.append(at)
            elif node < 0:
                which.append(at)
                leaf.append(np.full(len(at), ~node))
            else:
                d = np.bitwise_count(x[at] ^ self.point[node])
                m = self.limit[node]
                todo += [(self.child[node][0], at[d <= m]), (self.child[node][1], at[d > m - self.radius])]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *which]), np.concatenate([none, *leaf]), np.unique(np.concatenate([none, *crowd]))


def _compare(x: np.ndarray, radius: int) -> np.ndarray:
    """For each of a few fingerprints the first it is connected with."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        least = np.where(near, label[None, :], len(x)).min(axis=1)
        if (least == label).all():
            return label
        label = least[least]


def _crowd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of a crowd within two bits, by the fingerprints between them."""
    mid = np.concatenate([x, *(x ^ b for b in _BITS)])
    who = np.tile(np.arange(len(x)), 65)
    order = np.argsort(mid, kind="stable")
    same = mid[order][1:] == mid[order][:-1]
    return who[order][:-1][same], who[order][1:][same]


def shard_links(x: np.ndarray, radius: int = RADIUS, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints of a shard that connect all that links within ``radius`` connect.

    At most one pair for each fingerprint and part of the tree, whatever the number of links.
    """
    rng = np.random.default_rng(2)
    a, b = [], []
    todo = [x]
    while todo:
        y = todo.pop()
        if len(y) < 2:
            continue
        choice = parted(y, radius, rng) if len(y) > small else None
        if choice is not None:
            d = np.bitwise_count(y ^ choice[0])
            todo += [y[d <= choice[1]], y[d > choice[1] - radius]]
        elif len(y) <= 2 * small or radius != 2:
            for k in range(0, len(y), 4096):  # one block, but for another radius than 2
                for j in range(k, len(y), 4096):
                    part = y[k : k + 4096] if j == k else np.concatenate([y[k : k + 4096], y[j : j + 4096]])
                    label = _compare(part, radius)
                    own = label != np.arange(len(part))
                    a.append(part[own])
                    b.append(part[label[own]])
        else:
            i, j = _crowd(y)
            a.append(y[i])
            b.append(y[j])
    none = np.zeros(0, U64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard: int = SHARD, most_shards: int = MOST_SHARDS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all fingerprints within ``radius`` bits.

    ``distinct`` has one row per fingerprint in the column fp.  Pairs span the components; they
    are not every link.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    sample = min(max(sample, total // ONE_IN), MOST_SEEN)
    seen = np.sort(thinned(distinct.select("fp"), sample, "fp").toPandas()["fp"].to_numpy(np.int64))
    tree = spark.sparkContext.broadcast(Tree(seen.view(U64), total, shard, most_shards, radius))  # some MB at most
    routed = pa.schema([("leaf", pa.int32()), ("fp", pa.int64()), ("mid", pa.int64())])

    def route(batches):
        for b in batches:
            x = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(U64)
            for k in range(0, len(x), 4096):
                y = x[k : k + 4096]
                which, leaf, crowd = tree.value.route(y)
                yield batch(routed, [leaf.astype(np.int32), y[which].view(np.int64), y[which].view(np.int64)])
                if len(crowd):
                    c = y[crowd]
                    mid = np.concatenate([c, *(c ^ bit for bit in _BITS)])
                    yield batch(routed, [np.full(len(mid), -1, np.int32), np.tile(c, 65).view(np.int64), mid.view(np.int64)])

    def solve(batches):
        leaf, held = None, []

        def flush():
            a, b = shard_links(np.unique(np.concatenate(held)), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:  # rows come in the order of leaves
            leaves = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            edges = np.flatnonzero(np.diff(leaves)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True):
                if e == s:
                    continue
                if leaf is not None and leaves[s] != leaf:
                    yield flush()
                    held = []
                leaf = leaves[s]
                held.append(x[s:e])
        if held:
            yield flush()

    dealt = distinct.select("fp").mapInArrow(route, "leaf int, fp long, mid long")
    shards = dealt.where("leaf >= 0").select("leaf", "fp").repartition("leaf").sortWithinPartitions("leaf")
    near = shards.mapInArrow(solve, "a long, b long")
    if any(c is None for pair in tree.value.child for c in pair) or tree.value.root is None:
        # at most 65 fingerprints of a crowd meet at one in between
        crowd = dealt.where("leaf < 0").groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("met")).where("size(met) > 1")
        near = near.unionByName(crowd.select(F.col("met")[0].alias("a"), F.explode(F.slice("met", F.lit(2), F.size("met") - 1)).alias("b")))
    return near


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest doc_id that
    links lead to, the row's own included.  Equal fingerprints, those of empty and null texts
    too, are one component.  A null doc_id keeps its row and never becomes a component_id
    (which is null if a component has no other).  Rows that repeat give as many rows.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, radius, **tree))
    known = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(known.select("fp", "root").join(roots, "root").select(F.col("fp").alias("known_fp"), "component_id"))
    return fps.join(known, fps["fp"] == known["known_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns kept.

    Documents are linked if the Jaccard similarity of their shingles is ``similarity`` or more
    (by ``similar``, which verifies what the tree finds within ``radius`` bits and searches the
    rest by shingles, as no radius holds for a similarity), or with None if their fingerprints
    lie within ``radius`` bits.  Rows without an id stay.  Of repeated rows
    with one id all stay or all go.  Other columns may have any names.
    """
    if similarity is None:
        found = near_duplicates(docs, shingle, radius, id_col, text_col, **tree)
    else:
        from moraine.llm.similar import near_duplicates as similar

        found = similar(docs, shingle, similarity, radius, id_col, text_col, **tree)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    names = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    stay = own.join(bounded(gone, 16), F.col(names[id_col]).cast("long") == F.col("gone_id"), "left_anti")
    return stay.select(*(F.col(n).alias(c) for c, n in names.items()))
