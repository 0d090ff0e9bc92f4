"""Prediction logging as a stream, and one monitoring cycle over the tables that streams keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.config import DecisionSettings, RetrainThresholds
from holdfast.operators.labels import labeled_predictions, score_predictions
from holdfast.operators.metrics import merge_states, metric_state, performance_row, report_of_state
from holdfast.operators.rules import retrain_decision
from holdfast.sources.tables import append_history, path_exists
from holdfast.streaming import labels as label_streams


def log_stream(predictions: DataFrame, path: str, checkpoint: str, ts: str = "prediction_timestamp", available_now: bool = True, by_month: bool = False) -> StreamingQuery:
    """Append a prediction stream to the log, each row once: a folder per day, or per month for a log of few rows and many days."""
    day, part = F.to_date(ts), "prediction_month" if by_month else "prediction_date"
    dated = predictions.withColumn(part, F.date_format(day, "yyyy-MM") if by_month else day)
    writer = dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(part)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _decided(row: DataFrame, thresholds: RetrainThresholds, retrain: Callable[[], bool] | None) -> DataFrame:
    """The metric row with ``retrain_triggered`` and ``champion_promoted``. If the rule asks for it and there is a ``retrain``, that is run; it says whether its model
    was promoted."""
    decided = retrain_decision(row, thresholds)
    promoted = False
    if retrain is not None and decided.select("retrain").first().retrain:
        promoted = bool(retrain())
    return decided.withColumns({"retrain_triggered": F.col("retrain"), "champion_promoted": F.lit(promoted)}).drop("retrain")


def monitoring_cycle(
    log: DataFrame,
    labels: DataFrame,
    history: str,
    threshold: float = 0.5,
    at: Column | None = None,
    moment: str = "prediction_timestamp",
    decisions: DecisionSettings = DecisionSettings(),
    thresholds: RetrainThresholds = RetrainThresholds(),
    retrain: Callable[[], bool] | None = None,
) -> DataFrame:
    """Evaluate all labeled predictions, decide, retrain if need be (see :func:`monitoring_day`), and append to the performance history."""
    joined = labeled_predictions(score_predictions(log, threshold), labels)
    row = performance_row(joined, "churn", "churn_probability", "action", moment, "expected_profit", threshold, decisions)
    return append_history(_decided(row, thresholds, retrain), history, "timestamp", at)


def monitoring_day(
    spark: SparkSession,
    log: DataFrame,
    folder: str,
    until: str,
    threshold: float = 0.5,
    moment: str = "prediction_timestamp",
    decisions: DecisionSettings = DecisionSettings(),
    thresholds: RetrainThresholds = RetrainThresholds(),
    retrain: Callable[[], bool] | None = None,
) -> DataFrame:
    """One monitoring cycle: release the labels due up to ``until``, measure, decide, retrain if need be, and keep the row in the history, which it returns.

    Under ``folder`` lie ``waiting`` and ``released`` (see ``labels.enqueue_labels``), ``states`` and ``history``. Only the labels of this release are joined with the log; they
    become a metric state, one row per distinct score. The metrics come from all states merged, so no earlier prediction is read again. Each part is
    written under ``until``: a cycle that broke off is done again as a whole, and one that is over is not repeated. ``retrain`` trains, compares and registers a model, and says whether it
    was promoted, such as :func:`holdfast.jobs.promote_job` does.
    """
    state, row_path = f"{folder}/states/until={until}", f"{folder}/history/until={until}"
    if not path_exists(spark, f"{row_path}/_SUCCESS"):
        due = label_streams.release_due(spark, f"{folder}/waiting", f"{folder}/released", until)
        joined = labeled_predictions(score_predictions(log, threshold), due.select("prediction_id", "churn"))
        new = metric_state(joined, "churn", "churn_probability", "action", moment, "expected_profit", decisions)
        new.write.mode("overwrite").parquet(state)
        states = spark.read.schema(new.schema).option("basePath", f"{folder}/states").parquet(f"{folder}/states")
        merged = merge_states(states.where(F.col("until").cast("string") <= until) if "until" in states.columns else states)
        # Nothing is measured before the first label.
        if merged.limit(1).count():
            _decided(report_of_state(merged, threshold), thresholds, retrain).write.mode("overwrite").parquet(row_path)
    return read_days(spark, folder)


def read_days(spark: SparkSession, folder: str) -> DataFrame:
    """The performance history of :func:`monitoring_day`, one row per cycle that had labels."""
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/history")
