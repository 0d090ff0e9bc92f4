"""Query op1: the language of all documents, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import remainder, table
from holdfast.llm.language import LanguageModel, fit, identify

NAME = "op1_language"
SQL = None


def learned(docs: DataFrame) -> LanguageModel:
    return fit(docs.where(remainder("doc_id", 4) != 2))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learned(docs))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "share", "n_words", "spans")
