"""Feature drift between a reference and a current table: all features of a kind in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DriftSettings
from holdfast.functions.scalars import number_column
from holdfast.functions.stats import kolmogorov_tail, with_chi_square_tail, with_kolmogorov_exact
from holdfast.operators.features import long_rows, long_text, names_frame
from holdfast.operators.ordering import collapse, running_totals

SIDE = "is_reference"
# Fixed value: smallest expected count of a category the reference does not have.
EXPECTED_FLOOR = 1e-9


def both_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables with a flag that tells them apart."""
    picked = [F.col(f"`{c}`") for c in columns]
    return reference.select(*picked, F.lit(True).alias(SIDE)).unionByName(current.select(*picked, F.lit(False).alias(SIDE)))


def _result(tests: DataFrame, kind: str, metric: str, threshold: float, drift: Column, s: DriftSettings) -> DataFrame:
    enough = (F.col("reference_n") >= s.min_samples) & (F.col("current_n") >= s.min_samples)
    return tests.select(
        "feature",
        F.lit(kind).alias("feature_type"),
        F.lit(metric).alias("metric_type"),
        F.when(enough, F.col("statistic")).otherwise(0.0).alias("score"),
        F.when(enough, F.col("p")).otherwise(1.0).alias("p_value"),
        F.when(enough, F.col("p_method")).otherwise("").alias("p_method"),
        F.lit(threshold).alias("threshold"),
        F.coalesce(enough & drift, F.lit(False)).alias("drift_detected"),
        "reference_n",
        "current_n",
        F.when(enough, "").otherwise("insufficient_samples").alias("reason"),
    )


def numeric_drift(sides: DataFrame, features: Sequence[str], s: DriftSettings = DriftSettings()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test for each feature of :func:`both_sides`.

    Drift needs a small p-value and a large distance. Values that are not numbers are left out. ``p_method`` says whether the p-value is exact
    or the large-sample one; samples with ties are treated as if they had none, which makes the exact one cautious.
    """
    rows = long_rows(sides, {c: number_column(sides, c) for c in features}, keep=[SIDE])
    counted = collapse(rows, "value", {"ref": F.col(SIDE).cast("int"), "cur": (~F.col(SIDE)).cast("int")}, ["feature"])
    ranked = running_totals(counted, "value", ["ref", "cur"], ["feature"])
    gap = F.abs(F.try_divide(F.col("cum_ref"), F.col("all_ref")) - F.try_divide(F.col("cum_cur"), F.col("all_cur")))
    tests = ranked.groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.max("all_ref").alias("reference_n"), F.max("all_cur").alias("current_n")
    )
    # A feature without a single number still gets its row.
    tests = names_frame(sides.sparkSession, features).join(tests, "feature", "left").select(
        "feature",
        F.coalesce("statistic", F.lit(0.0)).alias("statistic"),
        F.coalesce("reference_n", F.lit(0)).cast("bigint").alias("reference_n"),
        F.coalesce("current_n", F.lit(0)).cast("bigint").alias("current_n"),
    )
    usable = (F.col("reference_n") > 0) & (F.col("current_n") > 0)
    tests = with_kolmogorov_exact(tests, "statistic", "reference_n", "current_n", "_exact", s.exact_cells)
    large = kolmogorov_tail(F.col("statistic"), F.greatest("reference_n", F.lit(1)), F.greatest("current_n", F.lit(1)))
    tests = tests.withColumns(
        {
            "p": F.when(usable, F.coalesce("_exact", large)).otherwise(1.0),
            "p_method": F.when(F.col("_exact").isNotNull(), "exact").otherwise("large_sample"),
        }
    )
    drift = (F.col("p") < s.p_value_threshold) & (F.col("statistic") > s.stat_threshold)
    return _result(tests, "numeric", "ks", s.stat_threshold, drift, s)


def categorical_drift(sides: DataFrame, features: Sequence[str], s: DriftSettings = DriftSettings()) -> DataFrame:
    """Chi-square goodness of fit for each feature; a missing value is a category of its own."""
    rows = long_text(sides, features, keep=[SIDE]).select(SIDE, "feature", F.coalesce("value", F.lit("MISSING")).alias("value"))
    counts = rows.groupBy("feature", "value").agg(
        F.count_if(F.col(SIDE)).alias("ref"), F.count_if(~F.col(SIDE)).alias("cur")
    )
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("reference_n"), F.sum("cur").alias("current_n"))
    expected = F.greatest(
        F.coalesce(F.try_divide(F.col("ref"), F.col("reference_n").cast("double")), F.lit(0.0)) * F.col("current_n"), F.lit(EXPECTED_FLOOR)
    )
    part = (F.col("cur") - expected) * (F.col("cur") - expected) / expected
    tests = (
        # One row per feature the caller named.
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg(
            F.sum(part).alias("statistic"),
            (F.count("*") - 1).alias("dof"),
            F.max("reference_n").alias("reference_n"),
            F.max("current_n").alias("current_n"),
        )
    )
    tests = with_chi_square_tail(tests, "statistic", "dof", "p").withColumn("p_method", F.lit("large_sample"))
    return _result(tests, "categorical", "chisquare", s.p_value_threshold, F.col("p") < s.p_value_threshold, s)


def drift_report(
    reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str], s: DriftSettings = DriftSettings()
) -> DataFrame:
    """Long result over all features both tables have."""
    common = set(reference.columns) & set(current.columns)
    numeric = [c for c in numeric if c in common]
    categorical = [c for c in categorical if c in common]
    parts = []
    if numeric:
        parts.append(numeric_drift(both_sides(reference, current, numeric), numeric, s))
    if categorical:
        parts.append(categorical_drift(both_sides(reference, current, categorical), categorical, s))
    if not parts:
        raise ValueError("No feature is present on both sides.")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drift_summary(report: DataFrame) -> DataFrame:
    """Checked and drifted features, their names, and whether any drifted. One row per feature goes in."""
    drifted = F.coalesce(F.col("drift_detected"), F.lit(False))
    return report.agg(
        F.count("*").alias("checked_features"),
        F.count_if(drifted).alias("drifted_features"),
        F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))).alias("drifted_feature_names"),
        F.coalesce(F.bool_or(drifted), F.lit(False)).alias("drift_detected"),
    )
