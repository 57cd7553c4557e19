"""What depends on order: latest, attempts, first of equals, ranks, sliding counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by an order; sums before the shuffle, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return top.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest)).select(*df.columns)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an order."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return top.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest)).select(*df.columns)


def attempt_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "attempt_index") -> DataFrame:
    """The number of each row within its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def merge_logs(a: DataFrame, b: DataFrame, key: str = "run_id", order: Sequence[str] = ("finished_at", "started_at"), ties: Sequence[str] = ()) -> DataFrame:
    """Both logs with the last event of each run, by the order with nulls first; of equals, the second log's."""
    both = a.withColumn("_from", F.lit(0)).unionByName(b.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], [*order, "_from", *ties]).drop("_from")  # the greatest, in which null is less than all


def number_rows(df: DataFrame, order: Sequence[str], start: int = 0, name: str = "id") -> DataFrame:
    """Contiguous numbers in an order: places within ranges of the order, after the counts of the ranges before.

    No task sees all rows; the driver sees one count for each range.  The ranges are written to
    the shared folder once, with each row's range and place: a second run of the plan could cut
    them elsewhere, as the bounds come from a sample and adaptive execution joins small ranges.
    Rows that tie on the whole order are numbered in any order.
    """
    from moraine.sources.shared import kept

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = kept(ranged.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + F.lit(start)).drop("_part", "_at", "_before")


def triangulation_ids(phases: DataFrame, polytope: Sequence[str], order: Sequence[str | Column], name: str = "triang_id") -> DataFrame:
    """The rank of each phase of a polytope under a composite order, from 0."""
    return phases.withColumn(name, F.row_number().over(Window.partitionBy(*polytope).orderBy(*order)) - 1)


def rolling_count(df: DataFrame, ts: str, seconds: int, keys: Sequence[str] = (), name: str = "n_recent") -> DataFrame:
    """Rows of the same key in the last ``seconds``, the row's own included.

    Without keys the rows are counted by second first, so that what one task orders is a row a second.
    """
    second = F.col(ts).cast("timestamp").cast("long")
    if keys:
        frame = Window.partitionBy(*keys).orderBy(second).rangeBetween(-seconds, Window.currentRow)
        return df.withColumn(name, F.count("*").over(frame))
    each = df.groupBy(second.alias("_second")).agg(F.count("*").alias("_n"))
    recent = each.select("_second", F.sum("_n").over(Window.orderBy("_second").rangeBetween(-seconds, Window.currentRow)).alias(name))
    return df.withColumn("_at", second).join(recent, F.col("_at").eqNullSafe(F.col("_second"))).drop("_at", "_second")
