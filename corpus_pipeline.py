"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Defined results: documents whose text is null or has no letter go in the first stage; a repeated row is judged by its own
text, and copies of a text (one doc_id or several) leave one row; rows with a null doc_id are taken as any other, but for
the join of near copies, in which they stay; further columns go along unchanged, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from castlake.llm import bpe_stream, decontam, dedup, langid, queries, toxicity
from castlake.llm.shared import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language: a letter, and a likeliest language of at least langid.SURE times chance."""
    return langid.kept(docs, queries.language_model(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score under 0.7."""
    return toxicity.kept(docs, queries.toxicity_model(docs, spark, sf_dir), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the least id, of each component."""
    return dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item occurs."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of what is left: ids, and what they decode to."""
    return bpe_stream.digests(docs, queries.vocabulary_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_stream", encoding),
]

#: Trained models and searches by signatures have no SQL form; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
