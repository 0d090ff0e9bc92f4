"""Monitoring rules: metric rows in, decision rows out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import RetrainThresholds
from holdfast.operators.metrics import ratio


def latest_row(history: DataFrame, moment: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """Newest row of a history table (per key, if given), by a combinable maximum. Equal times fall back to the other columns."""
    rest = [c for c in history.columns if c != moment and c not in by]
    return history.groupBy(*by).agg(F.max(F.struct(moment, *rest)).alias("_last")).where("_last IS NOT NULL").select(
        *by, *[F.col(f"_last.{c}").alias(c) for c in [moment, *rest]]
    )


def _missed(name: str, value: Column, limit: float) -> Column:
    return F.format_string(f"{name} is %.3f, limit {limit:g}", value)


def retrain_decision(
    metrics: DataFrame, s: RetrainThresholds = RetrainThresholds(), flag: str | None = None
) -> DataFrame:
    """Add ``retrain`` and ``retrain_reason`` to metric rows. A missing metric is skipped; the first hit gives the reason."""
    n, f1, recall, auc, brier = (F.col(c) for c in ("n_samples", "f1_score", "recall", "roc_auc", "brier_score"))
    hits = [
        (f1 < s.min_f1, "F1", f1, s.min_f1),
        (recall < s.min_recall, "Recall", recall, s.min_recall),
        (auc < s.min_roc_auc, "ROC AUC", auc, s.min_roc_auc),
        (brier > s.max_brier_score, "Brier score", brier, s.max_brier_score),
    ]
    few = F.coalesce(n, F.lit(0)) < s.min_samples
    retrain = F.when(few, False)
    reason = F.when(few, "Too few labels to judge by.")
    for hit, name, value, limit in hits:
        retrain = retrain.when(hit, True)
        reason = reason.when(hit, _missed(name, value, limit))
    if flag:
        stored = F.coalesce(F.col(flag), F.lit(False))
        retrain = retrain.when(stored, True)
        reason = reason.when(stored, "An earlier check asked for it.")
    return metrics.withColumns(
        {"retrain": retrain.otherwise(False), "retrain_reason": reason.otherwise("Every metric keeps its limit.")}
    )


def skip_training(drift: Column, forced: Column) -> Column:
    return ~drift & ~forced


def run_strategy(drift: Column, forced: Column) -> Column:
    return F.when(drift, "EMERGENCY").when(forced, "FORCED").otherwise("STABLE")


def retrain_outcome(retrain: Column, promoted: Column) -> Column:
    return (
        F.when(~F.coalesce(retrain, F.lit(False)), "skipped")
        .when(F.coalesce(promoted, F.lit(False)), "retrained_and_promoted")
        .otherwise("retrained_no_promotion")
    )


def alerts(rows: DataFrame, when: Column, title: Column, message: Column, severity: Column | str = "warning", keep: Sequence[str] = ()) -> DataFrame:
    """Alert rows with a severity and the text to be sent."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.where(when).select(
        *keep,
        level.alias("severity"),
        F.concat(F.lit("["), F.upper(level), F.lit("] "), title, F.lit("\n"), message).alias("text"),
    )


def latest_aliases(assignments: DataFrame, alias: str = "alias", moment: str = "assigned_at") -> DataFrame:
    """Current version of each alias: the newest assignment wins. Other aliases than champion and challenger are not served."""
    valid = assignments.where(F.col(alias).isin("champion", "challenger"))
    return latest_row(valid, moment, [alias])


def served_alias(requested: Column) -> Column:
    """Alias to serve: the requested one if it is known, else champion."""
    wanted = F.lower(F.trim(requested))
    return F.when(wanted.isin("champion", "challenger"), wanted).otherwise("champion")


def compare_models(scored: DataFrame, y: str, scores: dict[str, tuple[str, float]]) -> DataFrame:
    """F1 of each model at its own threshold on the same rows, and whether the challenger is promoted.

    ``scores`` maps 'challenger' and, if there is one, 'champion' to (score column, threshold). The challenger
    must be strictly better; without a champion it is promoted.
    """
    sums = []
    for name, (column, threshold) in scores.items():
        hit = F.col(column) >= threshold
        sums += [
            F.count_if(hit & (F.col(y) == 1)).alias(f"tp_{name}"),
            F.count_if(hit & (F.col(y) == 0)).alias(f"fp_{name}"),
            F.count_if(~hit & (F.col(y) == 1)).alias(f"fn_{name}"),
        ]
    counts = scored.agg(*sums)

    def f1(name: str) -> Column:
        tp, fp, fn = (F.col(f"{k}_{name}") for k in ("tp", "fp", "fn"))
        return ratio(tp * 2, tp * 2 + fp + fn)

    columns = []
    for name, (_, threshold) in scores.items():
        columns += [f1(name).alias(f"{name}_f1"), F.lit(float(threshold)).alias(f"{name}_decision_threshold")]
    promoted = f1("challenger") > f1("champion") if "champion" in scores else F.lit(True)
    return counts.select(*columns, promoted.alias("is_better"))
