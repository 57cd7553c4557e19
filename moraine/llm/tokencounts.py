"""Token counts of a corpus from one exact histogram of encoded lengths (operator 8).

Every document is encoded once.  Documents are then only counted by length; sums over the
longer and the shorter lengths answer totals, quantiles and truncated totals for every
context limit.  The histogram has a row for each length that occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.llm.bpe import over_texts
from moraine.llm.textkit import cut

#: Lengths are summed within runs of this many, then over the runs, so no window spans all rows.
RUN = 1024


def lengths(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row of ``docs``, repeated ones included.

    A null or empty text has no tokens; a text of any length is encoded whole.  Columns other
    than id and text are not read.
    """
    return over_texts(docs, lambda own, ids: (len(ids),), "doc_id long, n_tokens long", path, pattern, id_col, text_col)


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per encoded length, with the answers for a context limit of that length.

    Columns: n_tokens, n_docs (of this length), docs_longer, docs_up_to, tokens_up_to (in
    documents of at most this length), total_docs, total_tokens, truncated_tokens (left if
    every document is cut after n_tokens), lost_tokens, quantile (the share of documents of
    at most this length).  Null lengths count as 0.  An empty table gives no rows.
    """
    # a row for each length, written once: the plan below reads it twice, and texts must be encoded once
    h = cut(counted.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs")))
    h = h.withColumns({"run": F.floor(F.col("n_tokens") / RUN), "tokens": F.col("n_tokens") * F.col("n_docs")})
    inside = Window.partitionBy("run").orderBy("n_tokens")
    h = h.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)})
    # as many rows as there are runs of lengths: the longest text's tokens / RUN at most
    runs = h.groupBy("run").agg(F.sum("n_docs").alias("rd"), F.sum("tokens").alias("rt"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    runs = runs.select(
        "run",
        F.coalesce(F.sum("rd").over(before), F.lit(0)).alias("bd"),
        F.coalesce(F.sum("rt").over(before), F.lit(0)).alias("bt"),
        F.sum("rd").over(everything).alias("total_docs"),
        F.sum("rt").over(everything).alias("total_tokens"),
    )
    h = h.join(runs, "run").withColumns({"docs_up_to": F.col("bd") + F.col("d"), "tokens_up_to": F.col("bt") + F.col("t")})
    h = h.withColumn("docs_longer", F.col("total_docs") - F.col("docs_up_to"))
    h = h.withColumn("truncated_tokens", F.col("tokens_up_to") + F.col("n_tokens") * F.col("docs_longer"))
    return h.select("n_tokens", "n_docs", "docs_longer", "docs_up_to", "tokens_up_to", "total_docs", "total_tokens", "truncated_tokens", (F.col("total_tokens") - F.col("truncated_tokens")).alias("lost_tokens"), (F.col("docs_up_to") / F.col("total_docs")).alias("quantile"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens and docs_cut for any context limits, whether a document has that length or not."""
    sums = [
        F.struct(
            F.lit(int(x)).cast("long").alias("limit"),
            F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")), F.lit(0)).cast("long").alias("truncated_tokens"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > int(x), F.col("n_docs"))), F.lit(0)).cast("long").alias("docs_cut"),
        )
        for x in limits
    ]
    return hist.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share and the smallest length that at least that share of documents does not exceed."""
    found = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return hist.agg(F.array(*found).alias("x")).select(F.inline("x"))
