"""URL filters: rules indexed by their rarest token, so that a URL runs only the few rules whose token it holds."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import workers_import

#: Rules that are sent to each task at most; some tens of MB with their compiled patterns.
MAX_RULES = 200_000

_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``pattern`` must match at the start of ``host + path``; the longest name wins, then the earlier rule.

    ``tokens`` are runs of letters and digits, in lower case, that every URL with a match holds as whole runs.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    final: bool = True


def host_rule(verdict: str, name: str) -> Rule:
    """``example.org/en/1`` fits example.org and its subdomains where the path starts with ``/en/1``."""
    host, _, path = name.partition("/")
    pattern = r"(?:[^/]*\.)?" + re.escape(host.lower()) + re.escape("/" + path)
    tokens = _TOKEN.findall(host.lower())
    # The last run of the path may go on in the URL, and so may one at its start that touches other letters.
    whole = path if path.endswith("/") else path.rpartition("/")[0] + "/" if "/" in path else ""
    if whole.isascii():
        tokens += _TOKEN.findall(whole.lower())
    return Rule(name, verdict, pattern, tuple(dict.fromkeys(tokens)))


def word_rule(verdict: str, word: str) -> Rule:
    """``cheap-pills`` fits URLs that hold these runs of letters and digits in a row, anywhere in the host or path, in any case."""
    return Rule(word, verdict, r"(?i:.*(?<![a-z0-9])" + re.escape(word) + r"(?![a-z0-9]))", tuple(_TOKEN.findall(word.lower())), final=False)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    # Only ASCII letters change case, as the contract of hosts has it.
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs. The driver gets one number for each token of the rules, which it knows already."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = pages.sparkSession
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("[a-z0-9]+"), F.lit(0)))
    # As many rows as the rules have tokens, which MAX_RULES bounds.
    listed = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))
    met = pages.select(F.explode(tokens).alias("token")).join(listed, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return {r["token"]: r["n"] for r in met.collect()}


class Matcher:
    """Rules by their rarest token; rules without a token are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules = rules
        self.patterns: list[re.Pattern | None] = [None] * len(rules)
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, rule in enumerate(rules):
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def candidates(self, url: str) -> list[int]:
        found = list(self.always)
        for token in set(_TOKEN.findall(url.lower())):
            found += self.by_token.get(token, ())
        return found

    def match(self, url: str) -> tuple[Rule | None, Rule | None]:
        """The winner among the final rules, and among the others."""
        best: dict[bool, int] = {}
        for i in self.candidates(url):
            rule = self.rules[i]
            held = best.get(rule.final)
            if held is not None and (len(self.rules[held].name), -held) >= (len(rule.name), -i):
                continue
            if self.patterns[i] is None:
                self.patterns[i] = re.compile(rule.pattern, re.DOTALL | re.ASCII)
            if self.patterns[i].match(url):
                best[rule.final] = i
        return tuple(self.rules[best[k]] if k in best else None for k in (True, False))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the pattern that decided without a host rule.

    Final rules (hosts and paths) come first: the longest that fits gives ``rule`` and ``verdict``. Otherwise the longest other
    rule gives the verdict and stands in ``pattern``, and without any the verdict is ``default``. A missing URL, or one without ``://``, has empty parts and gets
    ``default``. Repeated rows give equal results; other columns are not read; an empty table gives no rows.

    Rules are the caller's list, so they fit the driver; more than ``MAX_RULES`` are refused, since each task holds them. Each URL is judged
    where it is read. The only shuffle counts the rules' own tokens.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"More than {MAX_RULES} rules.")
    spark = pages.sparkSession
    workers_import(spark)
    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = url_parts(F.col("url"))
    parts = source.select("page_id", host.alias("host"), path.alias("path"))
    shared = spark.sparkContext.broadcast((rules, token_counts(parts, rules)))
    schema = pa.schema([("page_id", pa.int64()), *[(n, pa.string()) for n in ("host", "path", "rule", "verdict", "pattern")]])

    def work(batches):
        matcher = Matcher(*shared.value)
        for batch in batches:
            rows = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                final, other = matcher.match(host + path)
                rows.append((final and final.name, (final or other).verdict if final or other else default, None if final else other and other.name))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.string()) for c in columns]], schema=schema)

    return parts.mapInArrow(work, "page_id bigint, host string, path string, rule string, verdict string, pattern string")
