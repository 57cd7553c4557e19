"""Source divergence audit by joint count histograms (operator 13).

How far two sources of a language differ is a sum over all terms of a function of two counts.
Most terms share their two counts with many others, so for a pair of sources the terms are
tallied by (count, count), and the function is evaluated once for each such combination, times
its tally.  Cells with a zero are implied: they are the tallies of one source less those of
the combinations of both, and the cell of two zeros is what is left of the vocabulary.  So only
terms that both sources have are ever paired, never the whole vocabulary.

Terms are counted in the tasks that read the texts, by language and source; what is shuffled is
a row for each term of a source from each task, whatever the text's or the source's size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.textkit import Scratch, bounded, chunks, cut, short_batches

#: Documents of a language that a term must stand in.
LEAST_DOCS = 10
#: Terms of the part ``term``.
TOP = 10
SCALE = 1_000_000_000
#: Terms that a task holds before it sends its counts on.
HELD = 1 << 18
#: Bytes of a long text that are split at a time.
_PIECE = 1 << 20
#: White space for all that is not of a term; A-Z in lower case.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text whose other bytes are blanks, a bounded piece at a time."""
    a = 0
    while a < len(text):
        b = min(len(text), a + _PIECE)
        if b < len(text):
            b = text.rfind(b" ", a, b)
            b = text.find(b" ", a + _PIECE) if b <= a else b
            b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs of the texts of a task, in parts; a row without a term for every group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [None, *n]
            rows = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for rows in batches:
        langs, sources = rows.column("lang").to_pylist(), rows.column("source").to_pylist()
        for i, _, data, off in chunks(rows.column("text")):
            whole = data.tobytes().translate(_TERMS)
            for k in range(len(off) - 1):
                n, docs = held[langs[i + k], sources[i + k]]
                before = len(n)
                if off[k + 1] - off[k] <= _PIECE:
                    own = Counter(whole[off[k] : off[k + 1]].split())
                else:
                    own = Counter()
                    for piece in _pieces(whole[off[k] : off[k + 1]]):
                        own.update(piece)
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n occurrences and docs that have it; term is null in a row that every group has."""
    short_batches(docs.sparkSession)
    own = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = own.mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column | str, total: Column | str, v: Column | str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), in decimals: the product may be over 64 bits."""
    return F.expr(f"1 + cast((cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0))) div cast({total} + 2 * {v} as decimal(19,0)) as long)")


def _differ(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); below 2^63 as shares are up to 10^9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _joint(cells: DataFrame) -> DataFrame:
    """lang, s, t, c, d and times: how many terms of a language occur c times in source s and d times in t, for
    combinations without a zero and s before t.  Terms with the same counts in the same sources are one row first."""
    alike = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    alike = alike.groupBy("lang", "cells").agg(F.count("*").alias("times"))
    first = alike.select("lang", "cells", "times", F.posexplode("cells").alias("k", "one"))
    both = first.select("lang", "times", "one", F.explode(F.expr("slice(cells, k + 2, size(cells))")).alias("other"))
    return both.groupBy("lang", F.col("one.source").alias("s"), F.col("other.source").alias("t"), F.col("one.n").alias("c"), F.col("other.n").alias("d")).agg(F.sum("times").alias("times"))


def _pairs(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item and value for every ordered pair of sources of a language."""
    joint = _joint(cells)
    ends = totals.select("lang", F.col("source").alias("s"), "total", "v")
    other = totals.select(F.col("lang").alias("o_lang"), F.col("source").alias("t"), F.col("total").alias("o_total"))
    asked = ends.join(other, (F.col("lang") == F.col("o_lang")) & (F.col("s") < F.col("t"))).drop("o_lang")
    # a cell without a zero takes its terms out of the cells with one that the margins put them in
    signed = lambda c, d, n: F.struct(F.expr(f"{c}").alias("c"), F.expr(f"{d}").alias("d"), F.expr(f"{n}").alias("times"))
    inner = joint.select("lang", "s", "t", F.explode(F.array(signed("c", "d", "times"), signed("c", "0L", "-times"), signed("0L", "d", "-times"), signed("0L", "0L", "times"))).alias("x"))
    margin = cells.groupBy(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), "n").agg(F.count("*").alias("times"))
    edges = []
    for side, cell in (("s", ("n", "0L")), ("t", ("0L", "n"))):
        at = (F.col("lang") == F.col("m_lang")) & (F.col(side) == F.col("m_source"))
        edges.append(asked.select("lang", "s", "t").join(margin, at).select("lang", "s", "t", F.explode(F.array(signed(*cell, "times"), signed("0L", "0L", "-times"))).alias("x")))
    empty = asked.select("lang", "s", "t", signed("0L", "0L", "v").alias("x"))
    every = inner.unionByName(edges[0]).unionByName(edges[1]).unionByName(empty).groupBy("lang", "s", "t", "x.c", "x.d").agg(F.sum("x.times").alias("times")).where("times > 0")
    value = every.join(bounded(asked, 96), ["lang", "s", "t"]).select("lang", "s", "t", "times", _share("c", "total", "v").alias("p"), _share("d", "o_total", "v").alias("q"))
    value = value.groupBy("lang", "s", "t").agg(F.sum(F.col("times") * _differ("p", "q")).alias("value"))
    value = asked.select("lang", "s", "t").join(value, ["lang", "s", "t"], "left").select("lang", "s", "t", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    # the value of a pair is the same in both directions
    both = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item")))).alias("x")
    return value.select("lang", both, "value").select("lang", "x.source", "x.item", "value")


def _terms(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item and value for terms that a source has more of than its language."""
    own = totals.select("lang", "source", "total", "v")
    whole = totals.groupBy("lang").agg(F.sum("total").alias("l_total"))
    of = cells.groupBy("lang", "term").agg(F.sum("n").alias("l_n"))
    both = cells.join(of, ["lang", "term"]).join(bounded(own, 64), ["lang", "source"]).join(bounded(whole, 32), "lang")
    both = both.select("lang", "source", F.col("term").alias("item"), _share("n", "total", "v").alias("p"), _share("l_n", "l_total", "v").alias("q")).where("p > q")
    return both.select("lang", "source", "item", _differ("p", "q").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: how sources of a language differ, and by which terms.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` terms
    that a source has more of than its language; both are ranked by value, then item.  Terms are
    runs of letters A-Z, in lower case, and of characters beyond ASCII; a language keeps those
    of ``least_docs`` documents or more.

    Nulls in any of the three columns are empty texts, so rows without a language or a source are
    groups of their own.  A group without terms, or a language without kept terms, has its
    pairs (of value 0 if none is kept).  A repeated row counts as often as it stands there;
    an empty table gives no rows; other columns are not read.
    """
    with Scratch(docs.sparkSession) as keep:
        counts = keep.put(term_counts(docs, text_col, lang_col, source_col))
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
        cells = keep.put(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n"))
        vocabulary = cells.groupBy("lang").agg(F.count_distinct("term").alias("v"))
        totals = counts.where("term is null").select("lang", "source").join(bounded(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), 48), ["lang", "source"], "left")
        totals = keep.put(totals.join(bounded(vocabulary, 32), "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("v", F.lit(0).cast("long")).alias("v")))
        ranked = lambda df, part: df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
        # only the top terms of a task are shuffled
        terms = ranked(_terms(cells, totals), "term").where(F.col("rank") <= top)
        return cut(ranked(_pairs(cells, totals), "pair").unionByName(terms).select("lang", "source", "part", "item", "value", "rank"))
