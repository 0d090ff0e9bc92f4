"""Query op5: all documents mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.mixing import mix

NAME = "op5_mixing"
SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "text_hash")
