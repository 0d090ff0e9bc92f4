"""Query op12: passages of the benchmark in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.decontamination import contamination

NAME = "op12_decontamination"

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH items AS (
    SELECT item_id, coalesce({_WORDS}, []) AS words FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, words[i : i + 9] AS w FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS words FROM documents
), grams AS (
    SELECT r, i, n, words[i : i + n - 1] AS w
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (SELECT DISTINCT len(w) AS n FROM windows) WHERE len(words) >= n)
), matches AS (
    SELECT r, i, n, item_id FROM grams JOIN windows USING (w)
), hits AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM matches)) GROUP BY r
), found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM matches) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
