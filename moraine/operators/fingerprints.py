"""Fingerprints of a table of any size as a tree of hashes over ranges of its key.

A leaf holds the rows of a range that the key itself tells (an expression that goes up with the key),
so that it does not depend on how rows are dealt to tasks.  A leaf's digest combines the SHA-256
of its rows by addition in four lanes of 64 bits: rows are a multiset, their order is that of
the key, and no task gathers them.  A node above combines the digests of ``FAN`` children in
order.  Two tables are equal if their roots are; where they are not, the leaves that differ tell
which ranges do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node.
FAN = 256


def row_line(columns: Sequence[str]) -> Column:
    """A row as text; a null is told from the text ``null`` by a mark of its own."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))


def leaves(df: DataFrame, columns: Sequence[str], leaf: Column) -> DataFrame:
    """leaf, n_rows and digest for every range."""
    sha = F.sha2(row_line(columns), 256)
    lane = lambda k: F.sum(F.conv(F.substring(sha, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)"))
    told = df.groupBy(leaf.cast("long").alias("leaf")).agg(F.count("*").alias("n_rows"), *(lane(k).alias(f"_l{k}") for k in range(4)))
    return told.select("leaf", "n_rows", F.sha2(F.concat_ws("|", "n_rows", *(f"_l{k}" for k in range(4))), 256).alias("digest"))


def tree(df: DataFrame, columns: Sequence[str], leaf: Column) -> DataFrame:
    """level (0 for leaves), node, n_rows and digest; the highest level has one node, the root.

    Levels follow from the span of the leaves' numbers, which must not be negative.  An empty table has no nodes.
    """
    from moraine.sources.shared import kept

    level = kept(leaves(df, columns, leaf).withColumnRenamed("leaf", "node"))
    top = level.agg(F.max("node"), F.min("node")).first()
    if top[0] is None:
        return level.select(F.lit(0).alias("level"), "node", "n_rows", "digest")
    if top[1] is None or top[1] < 0:
        raise ValueError("numbers of ranges must not be negative")
    out, depth, widest = level.withColumn("level", F.lit(0)), 0, top[0]
    while widest > 0 or depth == 0:
        depth, widest = depth + 1, widest // FAN
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"]))
        level = level.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(children, "\n"), 256).alias("digest"))
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("level", "node", "n_rows", "digest")


def root(nodes: DataFrame) -> DataFrame:
    """The root's row; none for an empty table."""
    return nodes.groupBy().agg(F.max_by(F.struct("node", "n_rows", "digest"), "level").alias("x")).where("x is not null").select("x.n_rows", "x.digest")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """node, n_rows_a and n_rows_b of the ranges that are not the same in two trees; null where one has none."""
    side = lambda t, s: t.where("level = 0").select("node", F.col("n_rows").alias(f"n_rows_{s}"), F.col("digest").alias(f"digest_{s}"))
    both = side(a, "a").join(side(b, "b"), "node", "full_outer")
    return both.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))).select("node", "n_rows_a", "n_rows_b")
