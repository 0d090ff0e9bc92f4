"""Query op9: near copies among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.jaccard import near_copies

NAME = "op9_jaccard_join"
SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
