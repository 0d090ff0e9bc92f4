"""Named queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; leave out ``sql`` where SQL cannot express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Duplicate query: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded for comparison, since sums depend on the order of rows.

    ``other`` names columns with their own digits. Rounding is scale, round, unscale, as in the SQL engine:
    rounding the decimal text instead would differ on ties.
    """

    def one(f: T.StructField):
        column = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.DoubleType):
            return column
        scale = 10.0 ** other.get(f.name, digits)
        return (F.round(column * scale, 0) / scale).alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])
