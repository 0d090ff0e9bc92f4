"""Data quality: missing rates, unseen categories and one overall status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from holdfast.operators.features import long_text, names_frame

MAX_LISTED = 20


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a floating column."""
    value = F.col(f"`{column}`")
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_rate) for all columns from one aggregate; NaN counts as missing."""
    columns = list(columns or df.columns)
    rates = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in columns])
    return rates.unpivot([], [f"`{c}`" for c in columns], "column", "missing_rate")


def category_reference(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct known (feature, value) pairs."""
    return long_text(reference, features).where("value IS NOT NULL").distinct()


def unseen_categories(current: DataFrame, known: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: number of values the reference does not have, and the first twenty in sorted order.

    Values are made distinct before the anti-join. The list is built from ranked values, so a column full of
    new ids costs no more than its distinct values.
    """
    values = long_text(current, features).where("value IS NOT NULL").distinct()
    unseen = values.join(known, ["feature", "value"], "left_anti")
    counts = unseen.groupBy("feature").agg(F.count("*").alias("n"))
    # A limit per feature on a window is pushed into each task before the shuffle.
    rank = F.row_number().over(W.partitionBy("feature").orderBy("value"))
    listed = unseen.select("feature", "value", rank.alias("r")).where(F.col("r") <= MAX_LISTED)
    names = listed.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("names"))
    return (
        names_frame(current.sparkSession, features)
        .join(counts, "feature", "left")
        .join(names, "feature", "left")
        .select(
            "feature",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("unseen_category_count"),
            F.coalesce("names", F.lit("")).alias("unseen_categories"),
        )
    )


def quality_status(
    current: DataFrame, known: DataFrame | None, features: Sequence[str], enabled: bool = True, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: row count, columns with gaps, unseen values, and the status.

    The status is 'disabled', 'empty', 'warning' (any gap or unseen value) or 'ok'.
    """
    if not enabled:
        return current.agg(F.count("*").alias("row_count")).select("row_count", F.lit("disabled").alias("quality_status"))
    gaps = F.lit(0).cast("bigint")
    for c in columns if columns is not None else current.columns:
        gaps = gaps + F.coalesce(F.max(is_missing(current, c).cast("bigint")), F.lit(0))
    rows = current.agg(F.count("*").alias("row_count"), gaps.alias("columns_with_gaps"))
    if known is None:
        unseen = rows.select(F.lit(0).cast("bigint").alias("unseen_values"))
    else:
        values = long_text(current, features).where("value IS NOT NULL").distinct()
        unseen = values.join(known, ["feature", "value"], "left_anti").agg(F.count("*").alias("unseen_values"))
    # Two one-row frames.
    joined = rows.join(F.broadcast(unseen))
    status = (
        F.when(F.col("row_count") == 0, "empty")
        .when((F.col("columns_with_gaps") > 0) | (F.col("unseen_values") > 0), "warning")
        .otherwise("ok")
    )
    return joined.withColumn("quality_status", status)


def quality_by_batch(current: DataFrame, known: DataFrame, features: Sequence[str], batch: str, columns: Sequence[str]) -> DataFrame:
    """Row count, columns with gaps, unseen values and status of every request batch at once."""
    gaps = [F.max(is_missing(current, c).cast("int")) for c in columns]
    total = gaps[0]
    for g in gaps[1:]:
        total = total + g
    rows = current.groupBy(batch).agg(F.count("*").alias("row_count"), total.cast("bigint").alias("columns_with_gaps"))
    values = long_text(current, features, keep=[batch]).where("value IS NOT NULL").distinct()
    unseen = values.join(known, ["feature", "value"], "left_anti").groupBy(batch).agg(F.count("*").alias("unseen_values"))
    status = F.when((F.col("columns_with_gaps") > 0) | (F.col("unseen_values") > 0), "warning").otherwise("ok")
    return rows.join(unseen, batch, "left").withColumn("unseen_values", F.coalesce("unseen_values", F.lit(0)).cast("bigint")).withColumn(
        "quality_status", status
    )
