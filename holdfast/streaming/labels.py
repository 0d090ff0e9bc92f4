"""Predictions and the labels that follow weeks later, as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast.config import LabelSettings
from holdfast.sources.keyed_table import KeyedTable


def match_labels(
    predictions: DataFrame,
    labels: DataFrame,
    key: str = "prediction_id",
    predicted_at: str = "predicted_at",
    labeled_at: str = "labeled_at",
    s: LabelSettings = LabelSettings(),
    delay: str = "1 day",
) -> DataFrame:
    """Stream-stream join of predictions with labels delivered within the configured delay.

    Both sides carry a watermark, so state older than the longest delay is dropped. State is partitioned by key.
    Labels outside the interval stay out of the stream's state; ``reconcile_labels`` finds them afterwards.
    """
    p = predictions.withWatermark(predicted_at, delay)
    right = [c for c in labels.columns if c != key]
    l = labels.select(F.col(key).alias("_label_key"), *right).withWatermark(labeled_at, delay)
    within = F.expr(
        f"_label_key = {key} AND {labeled_at} >= {predicted_at} + INTERVAL {s.min_delay_days} DAYS "
        f"AND {labeled_at} <= {predicted_at} + INTERVAL {s.max_delay_days} DAYS"
    )
    return p.join(l, within, "inner").drop("_label_key")


def match_labels_batch(
    predictions: DataFrame, labels: DataFrame, key: str = "prediction_id", predicted_at: str = "predicted_at",
    labeled_at: str = "labeled_at", s: LabelSettings = LabelSettings(),
) -> DataFrame:
    """Batch twin of :func:`match_labels`."""
    joined = predictions.join(labels, key)
    wait = F.col(labeled_at).cast("timestamp") - F.col(predicted_at).cast("timestamp")
    return joined.where(
        (wait >= F.expr(f"INTERVAL {s.min_delay_days} DAYS")) & (wait <= F.expr(f"INTERVAL {s.max_delay_days} DAYS"))
    )


def reconcile_labels(predictions: DataFrame, labels: DataFrame, matched: DataFrame, key: str = "prediction_id", labeled_at: str = "labeled_at") -> DataFrame:
    """Delivered labels that ``matched`` does not hold, with their prediction, whatever the delay; null columns where no prediction was logged.

    With ``matched`` this accounts for every label: the reference for what counts is delivery, not the delay.
    """
    rest = labels.join(matched.select(key, labeled_at), [key, labeled_at], "left_anti")
    return rest.join(predictions, key, "left")


def _complete(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Values of the complete ``<prefix>=<value>`` folders of ``folder``, ascending."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    found = [status.getPath() for status in fs.listStatus(target) if status.getPath().getName().startswith(f"{prefix}=")]
    return sorted(p.getName().split("=", 1)[1] for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def released_until(spark: SparkSession, output: str) -> str | None:
    """The last day (yyyy-MM-dd) up to which labels have been released into ``output``."""
    runs = _complete(spark, output, "until")
    return runs[-1] if runs else None


def enqueue_labels(pending: DataFrame, available: str, waiting: str, output: str, checkpoint: str) -> StreamingQuery:
    """Put a stream of pending labels where :func:`release_due` finds them: by the day on which they are to be released, in a partition for each month.

    That is the day ``available`` says, or the day after the last release, for labels that arrive when their day is already over. Rows are written once and never
    again. A label without a day waits for good. What had been released when a micro-batch first came is kept beside it, so that a replay decides the same.
    """
    spark = pending.sparkSession

    def handle(rows: DataFrame, batch_id: int) -> None:
        known = f"{waiting}/known/micro_batch={batch_id}"
        if not _complete(spark, f"{waiting}/known", "micro_batch").count(str(batch_id)):
            line = spark.createDataFrame([(released_until(spark, output),)], "until string")
            line.coalesce(1).write.mode("overwrite").parquet(known)
        until = spark.read.schema("until string").parquet(known).first().until
        day = F.col(available).cast("date")
        if until is not None:
            day = F.greatest(day, F.date_add(F.lit(until).cast("date"), 1))
        placed = rows.withColumn("release_day", F.when(F.col(available).isNotNull(), day))
        placed = placed.withColumn("release_month", F.date_format("release_day", "yyyy-MM"))
        placed.hint("rebalance", "release_month").write.mode("overwrite").partitionBy("release_month").parquet(f"{waiting}/rows/micro_batch={batch_id}")

    return pending.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def release_due(spark: SparkSession, waiting: str, output: str, until: str) -> DataFrame:
    """Release the labels due up to ``until`` (yyyy-MM-dd) that no earlier run has released, and return them.

    Only the partitions of the months since the last run are read, and nothing that waits is rewritten. A run writes one folder, which counts when it is complete:
    a run that broke off is done again, one that is over is not. Days go forward only.
    """
    runs = _complete(spark, output, "until")
    target = f"{output}/until={until}"
    if runs and until < runs[-1]:
        raise ValueError(f"Labels have been released up to {runs[-1]} already.")
    if until not in runs:
        day, month = F.col("release_day"), F.col("release_month").cast("string")
        due = spark.read.parquet(f"{waiting}/rows").where((month <= until[:7]) & (day <= F.lit(until).cast("date")))
        if runs:
            due = due.where((month >= runs[-1][:7]) & (day > F.lit(runs[-1]).cast("date")))
        due.drop("micro_batch", "release_month").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_released(spark: SparkSession, output: str) -> DataFrame:
    """All released labels, with the day of the run that released each (``until``)."""
    runs = _complete(spark, output, "until")
    return spark.read.option("basePath", output).parquet(*[f"{output}/until={u}" for u in runs])


def latest_table(spark: SparkSession, table: str, key: str = "prediction_id", label: str = "churn", moment: str = "label_available_at", tie_break: Sequence[str] = (), buckets: int = 64) -> KeyedTable:
    """The table kept by :func:`keep_latest`: one row per key."""
    return KeyedTable(spark, table, key, [moment, *tie_break, label], buckets)


def keep_latest(
    deliveries: DataFrame,
    table: str,
    checkpoint: str,
    key: str = "prediction_id",
    label: str = "churn",
    moment: str = "label_available_at",
    tie_break: Sequence[str] = (),
    buckets: int = 64,
) -> StreamingQuery:
    """Keep the last label of each key: every micro-batch is merged into the buckets that its keys fall into, as a version of its own.

    Late corrections and repeated deliveries change nothing but the rows they are newer than; a replayed micro-batch is merged into the version before it again.
    """
    kept = latest_table(deliveries.sparkSession, table, key, label, moment, tie_break, buckets)
    columns = [key, moment, *tie_break, label]

    def handle(rows: DataFrame, batch_id: int) -> None:
        kept.merge(rows.where(F.col(label).isNotNull()).select(*columns), batch_id)

    return deliveries.select(*columns).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table: str, schema: T.StructType, key: str = "prediction_id", label: str = "churn", moment: str = "label_available_at", tie_break: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Current label of every key from the table kept by :func:`keep_latest`; ``schema`` is that of the deliveries."""
    columns = [key, moment, *tie_break, label]
    rows = latest_table(spark, table, key, label, moment, tie_break, buckets).read(T.StructType([schema[c] for c in columns]))
    return rows.select(key, label, moment)
