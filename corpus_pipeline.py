"""A corpus cleaned in five stages, each by an operator of ``moraine.llm``.

Each stage works on all rows that the one before it kept, written as Parquet in the shared
folder and read again.  All but the last return the columns of ``documents``; the last
returns the round trip of every text that is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import bpe, decontam, lines, simhash, toxicity
from moraine.llm.textkit import cut, delete, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine fitted on the labelled ones among them does not reject.

    Null and empty texts have the score of no terms; with no labelled document none is rejected.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line; n_chars stays that of the source.

    A document whose lines all go keeps its row with an empty text.  Null texts and rows without
    an id stay as they are; rows of one id and different texts are documents of their own.
    """
    return lines.deduplicate(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates: 0.8 of their five-word shingles or more.

    Texts without words are one group.  Rows without an id stay; of repeated rows with one id
    all stay or all go.
    """
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark; null and empty texts, and all if it is empty."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left, a row for each, null texts as empty ones."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The first and the last stage (a fitted machine, byte pair merges) have no SQL form; the
#: tests hold all five against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a table between two stages goes as soon as the next is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            path = f"{base}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if k:
                delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        delete(spark, base)
