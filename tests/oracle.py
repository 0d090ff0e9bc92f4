"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    """Differences between the Spark result and the SQL result; empty if they are the same."""
    df = fn(spark, sf_dir)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    if not got:
        return ["no rows"]
    problems = [f"{g} != {w}" for g, w in zip(got, want, strict=True) if g != w or any(type(a) is not type(b) for a, b in zip(g, w))]
    return problems[:3] + ([f"{len(problems)} rows differ"] if len(problems) > 3 else [])
