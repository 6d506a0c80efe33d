"""The corpus pipeline: documents through five operators, each stage on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import exact_dedup, jaccard_join, langid, mixing, sentencepiece_wfst
from chronoloom.llm.runtime import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n-grams of a learned language; texts without a letter or without any known n-gram go."""
    filters = langid.train(docs.filter(langid.remainder("doc_id", 3) != 1))
    return langid.accept(docs, filters)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, and whether these decode to the text."""
    return sentencepiece_wfst.encoded_documents(docs, sentencepiece_wfst.read_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("source_mixing", mix),
    ("sentencepiece", tokenise),
]

#: Training filters, transducers and components can't be said in SQL; a brute-force version tests it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
