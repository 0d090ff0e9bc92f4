"""Query op13: the trie of all conversations, rebuilt with shared heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.prefix_trie import conversation_trie

NAME = "op13_prefix_trie"

# crc32 is not a function of the SQL engine: it is computed bit by bit over the digits of the id.
_CRC = """
list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
"""

SQL = rf"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC}, 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL)
), parts AS (
    SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), rebuilt AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, length(role) || ':' || length(text) || ':' || role || text AS turn,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
    FROM parts
), paths AS (
    SELECT conv_id, pos AS depth, words, md5(string_agg(turn, '') OVER before) AS path FROM rebuilt WINDOW before AS (PARTITION BY conv_id ORDER BY pos)
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), members AS (
    SELECT p.*, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM paths p
), nodes AS (
    SELECT depth, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY depth, path
), counted AS (
    SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.parent = n.path AND k.depth = n.depth + 1) AS n_children
    FROM nodes n LEFT JOIN nodes u ON u.path = n.parent AND u.depth = n.depth - 1
), below AS (
    SELECT m.depth, m.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens
    FROM counted k JOIN members m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.depth, m.path
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN below USING (depth, path)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
