"""Query op10: near copies among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.embeddings import near_duplicates

NAME = "op10_embeddings"
SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
