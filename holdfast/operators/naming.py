"""Column-name profiles and the customer id spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _renamed(df: DataFrame, rule) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def feature_names(df: DataFrame) -> DataFrame:
    """Training profile: trimmed, lower case, spaces to underscores, no parentheses."""
    drop = str.maketrans({" ": "_", "(": None, ")": None})
    return _renamed(df, lambda c: c.strip().lower().translate(drop))


def request_names(df: DataFrame) -> DataFrame:
    """Request profile: lower case, spaces to underscores."""
    return _renamed(df, lambda c: c.lower().replace(" ", "_"))


def lower_names(df: DataFrame) -> DataFrame:
    """Drift profile: lower case only."""
    return _renamed(df, str.lower)


def _rename_unless_present(df: DataFrame, old: str, new: str) -> DataFrame:
    # Spark's own lookups ignore case, so the exact spellings are compared here.
    if old in df.columns and new not in df.columns:
        return df.toDF(*[new if c == old else c for c in df.columns])
    return df


def to_log_id(df: DataFrame) -> DataFrame:
    """``customerID`` to ``customerid`` (logs and features)."""
    return _rename_unless_present(df, "customerID", "customerid")


def to_raw_id(df: DataFrame) -> DataFrame:
    """``customerid`` to ``customerID`` (raw tables)."""
    return _rename_unless_present(df, "customerid", "customerID")


def normalize_raw(df: DataFrame) -> DataFrame:
    """Raw customers: totals as text, raw id spelling."""
    if "TotalCharges" in df.columns:
        df = df.withColumn("TotalCharges", df["TotalCharges"].cast("string"))
    return to_raw_id(df)


def drop_present(df: DataFrame, columns) -> DataFrame:
    """Drop the listed columns that exist under exactly that name."""
    return df.select(*[f"`{c}`" for c in df.columns if c not in set(columns)])
