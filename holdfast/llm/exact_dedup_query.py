"""Query op4: exact copies among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.exact_dedup import exact_groups

NAME = "op4_exact_dedup"

SQL = r"""
WITH plain AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents
), ranked AS (
    SELECT doc_id, p,
           first_value(doc_id) OVER (PARTITION BY p ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
           first_value(n) OVER (PARTITION BY p ORDER BY n DESC, doc_id NULLS LAST) AS most,
           n, count(*) OVER (PARTITION BY p) AS group_size
    FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = most AS kept, sha256(p) AS text_sha256 FROM ranked
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_points")
