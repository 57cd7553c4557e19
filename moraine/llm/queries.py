"""The queries of this subpackage, each an operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.oracles import ORACLES
from moraine.llm.textkit import remainder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the components of those within two bits, for every document."""
    from moraine.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score and verdict for every document, by a machine fitted on the labelled ones that are not held out."""
    from moraine.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of trees, fitted on labelled documents, for every document."""
    from moraine.llm.quality import judge, train

    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a classifier fitted on those that are not held out."""
    from moraine.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document stand in a window of 50 that a smaller document has, and a digest of the rest."""
    from moraine.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line with a word its class (the first line of the same set of words) and whether an earlier line matches it."""
    from moraine.llm.lines import verdicts

    return verdicts(table(spark, sf_dir, "documents")).drop("match_doc", "match_line")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets in every document: counts, places and scores."""
    from moraine.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by encoded length, with the sums that answer totals, quantiles and truncated totals."""
    from moraine.llm.tokencounts import histogram, lengths

    return histogram(lengths(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, for every document."""
    from moraine.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark, and where."""
    from moraine.llm.decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document, which row of it stays, and a digest of the text.

    Nulls are empty texts; of rows that repeat the least id one stays (see ``recipes.groups``).
    """
    from moraine.llm.recipes import groups

    return groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers, where they end together, and how frequent these pairs are, for every document.

    Null and empty texts, and those that the tokens do not give back, have zeros (see ``alignment.align``).
    """
    from moraine.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))[0]


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every two sources of a language differ, and the terms that tell a source from its language.

    Nulls are empty texts, languages and sources; ties go by item (see ``divergence.audit``).
    """
    from moraine.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_quality, op4_language, op5_substring, op6_lines, op7_pii, op8_token_counts, op9_bpe, op10_decontamination, op11_exact, op12_alignment, op13_divergence, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
