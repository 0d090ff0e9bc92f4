"""Query op7: encode and decode all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.bpe import digests, read_tokenizer
from holdfast.llm.common import table

NAME = "op7_bpe"
SQL = None


def tokenizer_text() -> str:
    import public_tokenizers

    return read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_text())
