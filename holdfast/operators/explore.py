"""Descriptive tables: histograms, crosstabs, summaries, codes, correlations and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import drop_nan
from holdfast.operators.features import long_rows, long_text
from holdfast.operators.joins import join_unique
from holdfast.operators.ordering import collapse, exact_quantiles, running_totals

QUARTILES = (0.25, 0.5, 0.75)


def score_histogram(df: DataFrame, score: str, bins: int = 25) -> DataFrame:
    """Rows in each of ``bins`` equal cells of [0, 1]; 1 belongs to the last cell."""
    cell = F.least(F.greatest(F.floor(drop_nan(F.col(score)) * bins), F.lit(0)), F.lit(bins - 1))
    return df.where(drop_nan(F.col(score)).isNotNull()).groupBy(cell.cast("int").alias("bin")).agg(F.count("*").alias("n")).select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("low"), "n"
    )


def crosstabs(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(column, value, target, n) of every column against the target in one pass."""
    return long_text(df, columns, "column", "value", [target]).groupBy("column", "value", target).agg(F.count("*").alias("n"))


def grouped_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max); quartiles are exact and interpolated."""
    rows = long_rows(df, {c: drop_nan(F.col(f"`{c}`")) for c in columns}, "column").where("value IS NOT NULL")
    # All figures come from one row per distinct value, and the table is read once.
    counted = collapse(rows, "value", {"_n": F.lit(1)}, ["column"])
    n, value = F.col("_n"), F.col("value")
    basic = counted.groupBy("column").agg(F.sum("_n").alias("count"), (F.sum(value * n) / F.sum("_n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    centred = counted.join(basic.select("column", F.col("mean").alias("_mean")), "column")
    square = (value - F.col("_mean")) * (value - F.col("_mean")) * n
    spread = centred.groupBy("column").agg(F.when(F.sum("_n") > 1, F.sqrt(F.sum(square) / (F.sum("_n") - 1))).alias("std"))
    quartiles = wide_quartiles(counted, "value", ["column"], weight=n)
    return basic.join(spread, "column").join(quartiles, "column").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def wide_quartiles(rows: DataFrame, value: str, groups: Sequence[str], weight: Column | None = None) -> DataFrame:
    q = exact_quantiles(rows, value, QUARTILES, groups, weight=weight)
    return q.groupBy(*groups).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(f"q{round(p * 100)}") for p in QUARTILES]
    )


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Five-number summary of a value by group."""
    rows = df.select(group, drop_nan(F.col(value)).alias("value")).where("value IS NOT NULL")
    ends = rows.groupBy(group).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(wide_quartiles(rows, "value", [group]), group).select(group, "min", "q25", "q50", "q75", "max")


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, unique, top, freq); the smaller text wins among equally frequent values."""
    counts = long_text(df, columns, "column", "value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), best.alias("best")
    ).select("column", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.rank")).alias("freq"))


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): alphabetical codes from 0. A near-unique column is ranked in parallel like any other."""
    levels = collapse(long_text(df, columns, "column", "value"), "value", {"rows": F.lit(1)}, ["column"])
    ranked = running_totals(levels.withColumn("one", F.signum("rows").cast("bigint")), "value", ["one"], ["column"])
    return ranked.select("column", "value", (F.col("cum_one") - 1).alias("code"))


def first_seen_codes(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(column, value, code): codes by first appearance in the unique ``order``."""
    seen = long_text(df, columns, "column", "value", [order]).where("value IS NOT NULL").groupBy("column", "value").agg(
        F.min(order).alias("first")
    )
    ranked = running_totals(seen.withColumn("one", F.lit(1).cast("bigint")), "first", ["one"], ["column"])
    return ranked.select("column", "value", (F.col("cum_one") - 1).alias("code"))


def encode(df: DataFrame, codes: DataFrame, column: str, alias: str) -> DataFrame:
    """Replace a column by its code. A hot value is spread, whatever the size of the lookup."""
    table = codes.where((F.col("column") == column) & F.col("value").isNotNull()).select(F.col("value").alias(column), F.col("code").alias(alias))
    return join_unique(df, table, column, "left")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    table = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    )
    return one.select(F.explode(table).alias("r")).select("r.*")


def target_correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(column, corr) with the target, largest first; from one aggregate, and as many rows as columns."""
    named = [c for c in columns if c != target]
    one = df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), F.col(f"`{target}`").cast("double")).alias(f"c{i}") for i, c in enumerate(named)])
    table = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(named)])
    return one.select(F.inline(table)).orderBy(F.desc_nulls_last("corr"), "column")


def density(df: DataFrame, value: str, group: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of a value by group on an even grid, with Scott's bandwidth.

    Values are collapsed first. One aggregate then keeps a sum per grid point, so no row is copied and the shuffle holds one row per
    group and task.
    """
    rows = df.select(group, drop_nan(F.col(value)).alias("v")).where("v IS NOT NULL")
    counted = rows.groupBy(group, "v").agg(F.count("*").alias("n"))
    stats = rows.groupBy(group).agg(
        F.count("*").alias("total"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    width = F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    grids = stats.where("sd > 0").select(group, "total", width.alias("bw"), (F.col("low") - cut * width).alias("start"),
                                         ((F.col("high") - F.col("low") + 2 * cut * width) / (points - 1)).alias("step"))
    placed = counted.join(grids, group)

    def point(i: Column | int) -> Column:
        return F.col("start") + i * F.col("step")

    def kernel(i: int) -> Column:
        z = (point(i) - F.col("v")) / F.col("bw")
        return F.exp(-0.5 * z * z) * F.col("n") / (F.col("bw") * F.col("total") * math.sqrt(2 * math.pi))

    sums = placed.groupBy(group).agg(F.first("start").alias("start"), F.first("step").alias("step"), *[F.sum(kernel(i)).alias(f"k{i}") for i in range(points)])
    cells = F.posexplode(F.array(*[F.col(f"k{i}") for i in range(points)])).alias("i", "density")
    return sums.select(group, "start", "step", cells).select(group, "i", point(F.col("i")).alias("x"), "density")
