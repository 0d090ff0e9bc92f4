"""Query op3: which pages' URLs are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import table
from holdfast.llm.urls import filter_urls, host_rule, word_rule

NAME = "op3_urls"

#: The rules of hosts and paths.
HOSTS = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: What else is blocked, wherever it stands in the host or path.
WORDS = ("casino", "casino-win", "bets", "free-bets", "pills", "cheap-pills", "poker", "xxx", "porn", "viagra", "torrent", "warez", "adult", "escort")

RULES = [host_rule(v, r) for v, r in HOSTS] + [word_rule("block", w) for w in WORDS]

_ALL = "|".join(WORDS)
_BY_LENGTH = sorted(WORDS, key=lambda w: (-len(w), WORDS.index(w)))
_LONGEST = "CASE " + " ".join(f"WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN '{w}'" for w in _BY_LENGTH) + " END"
SQL = rf"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
    FROM rest
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/en/1', 's') THEN 'example.org/en/1'
        WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/es/', 's') THEN 'example.org/es/'
        WHEN regexp_matches(host || path, '^([^/]*\.)?com/fr/', 's') THEN 'com/fr/'
        WHEN regexp_matches(host || path, '^([^/]*\.)?com/de/', 's') THEN 'com/de/'
        WHEN regexp_matches(host || path, '^([^/]*\.)?org/', 's') THEN 'org/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({_ALL})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict,
    CASE WHEN rule IS NULL THEN {_LONGEST} END AS pattern
FROM ruled
"""
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)
