"""The corpus pipeline: from raw documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import bpe, exact_dedup, jaccard, language, mixing
from holdfast.llm.bpe_query import tokenizer_text
from holdfast.llm.common import stored, table
from holdfast.llm.language_query import learned


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those in which no language has half of the words. A missing language is filled in."""
    return language.keep_languages(docs, learned(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with most code points stays, then that with the smallest id."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts."""
    return bpe.encode_rows(docs, tokenizer_text())


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language, similarity joins and BPE are beyond SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
