"""Query op2: secrets in all documents. The table's ``source`` is taken as repository and owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.secrets import scan_secrets

NAME = "op2_secrets"
SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
