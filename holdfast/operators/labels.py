"""Labels that arrive later: release, latest delivery, and the joins with predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import label_target, number_column, over_threshold
from holdfast.operators.joins import join_unique
from holdfast.operators.naming import to_log_id
from holdfast.operators.validation import require_rows


def latest_labels(deliveries: DataFrame, key: str, label: str, moment: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Last delivered label of each prediction. Deliveries without a key or a label do not count.

    A maximum over a struct is combined on the map side, so a key with many deliveries stays cheap.
    """
    valid = deliveries.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    order = F.struct(moment, *tie_break, label)
    return valid.groupBy(key).agg(F.max(order).alias("_last")).select(
        key, F.col(f"_last.{label}").alias(label), F.col(f"_last.{moment}").alias(moment)
    )


def labeled_predictions(predictions: DataFrame, labels: DataFrame, key: str = "prediction_id", label: str = "churn", required: bool = False) -> DataFrame:
    """Predictions that have a label. Both sides hold a key once, so there is no hot key to spread. With ``required`` it is an error if there is none; one row is looked for then."""
    joined = predictions.join(labels.select(key, label), key, "inner")
    return require_rows(joined, "No prediction has a label.") if required else joined


def attach_labels(predictions: DataFrame, labels: DataFrame | None, key: str = "prediction_id", label: str = "churn") -> DataFrame:
    """All predictions, with a label where there is one; unchanged if either side lacks the columns."""
    if labels is None or key not in predictions.columns or not {key, label} <= set(labels.columns):
        return predictions
    return join_unique(predictions.drop(label), labels.select(key, label), key, "left")


def pending_labels(
    logged: DataFrame, raw: DataFrame, day: Column, delay_days: int, key: str = "customerid", target: str = "Churn", suffix: str = "_raw"
) -> DataFrame:
    """Logged predictions with the raw row's label, to be released ``delay_days`` after ``day``.

    Raw rows must be unique by customer, otherwise predictions would multiply. Columns both sides have get a
    suffix on the raw side. An unknown label fails the job.
    """
    raw = to_log_id(raw)
    taken = {c for c in logged.columns if c != key}
    raw = raw.select(key, *[F.col(c).alias(c + suffix if c in taken else c) for c in raw.columns if c != key])
    joined = join_unique(logged, raw, key, "left")
    bad = F.raise_error(F.lit("A delivered label is neither yes nor no.")).cast("int")
    return joined.withColumns(
        {
            "churn": F.coalesce(label_target(F.col(target)), bad),
            "simulation_day": day,
            "label_available_day": F.date_add(day, delay_days),
        }
    )


def released(pending: DataFrame, as_of: Column, available: str) -> DataFrame:
    """Labels that are visible at ``as_of``."""
    return pending.where(F.col(available) <= as_of)


def released_between(pending: DataFrame, after: Column | None, until: Column, available: str) -> DataFrame:
    """Labels that become visible in (after, until]: each label is released once over consecutive runs."""
    rows = released(pending, until, available)
    return rows if after is None else rows.where(F.col(available) > after)


def ground_truth_rows(rows: DataFrame, batch_id: str, released_day: Column, target: str = "Churn") -> DataFrame:
    """Delivered labels in the shape of the ground-truth table."""
    churn = F.col("churn") if "churn" in rows.columns else label_target(F.col(target))
    return rows.withColumns(
        {"churn": churn, "label_batch_id": F.lit(batch_id), "released_simulation_day": released_day}
    )


def score_predictions(log: DataFrame, threshold: float = 0.5, prediction: str = "prediction") -> DataFrame:
    """Prediction log as monitoring reads it: probability, class, filled money fields and action flag."""
    expected = F.coalesce(number_column(log, "expected_value"), F.lit(0.0)) if "expected_value" in log.columns else F.lit(0.0)
    action = F.col("action") if "action" in log.columns else F.lit("no_action")
    score = number_column(log, prediction)
    return log.withColumns(
        {
            "churn_probability": score,
            "churn_prediction": F.coalesce(over_threshold(score, threshold), F.lit(0)),
            "decision_threshold": F.lit(float(threshold)),
            "expected_value": expected,
            "expected_profit": expected,
            "action": action,
            "is_actioned": action != "no_action",
        }
    )
