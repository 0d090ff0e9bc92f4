"""Query op6: all pages written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.warc import archived, write_warc
from holdfast.session import work_dir

NAME = "op6_warc"

SQL = """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return archived(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
