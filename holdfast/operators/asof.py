"""What was in force at a moment: the last earlier row of another table, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.scalars import over_threshold
from holdfast.operators.ordering import cut_points, default_buckets, with_bucket


def asof_join(
    rows: DataFrame,
    changes: DataFrame,
    moment: str,
    since: str,
    by: Sequence[str] = (),
    values: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """``rows`` with ``values`` and ``since`` of the last row of ``changes`` that has the same ``by`` and ``since`` <= ``moment``; missing ones where there is none.

    Both tables become one sequence per key, in which a moment takes the last change before it. The sequence is cut into buckets of time (a sample by hash gives the
    cuts), so a key that holds most rows is many windows; what is in force at the start of a bucket comes from the last change of the earlier ones, a table of one
    row per key and bucket. Rows with the same key and moment are one entry of the sequence. Changes at the same instant go by ``tie_break``, then by their values; a change
    without an instant never holds, and rows without a moment, or with a missing key, get missing values. Names in ``values`` must be new to ``rows``.
    """
    by, values = list(by), list(values)
    taken = {since, *values} & set(rows.columns)
    if taken:
        raise ValueError(f"Column {sorted(taken)[0]!r} is on both sides.")
    spark = rows.sparkSession
    buckets = buckets or default_buckets(spark)
    named = [F.col(f"`{c}`") for c in by]
    order = F.struct(*[F.col(f"`{c}`") for c in (*tie_break, *values)]) if tie_break or values else F.lit(0)
    known = F.lit(True)
    for c in named:
        known = known & c.isNotNull()
    kept = changes.where(F.col(since).isNotNull() & known).groupBy(*named, F.col(since).alias("_at")).agg(F.max(order).alias("_change"))
    asked = rows.where(F.col(moment).isNotNull() & known).select(*named, F.col(moment).alias("_at")).distinct()
    # A change comes before the rows of its own instant.
    both = kept.select(*named, "_at", F.lit(0).alias("_row"), F.struct(F.col("_at").alias("since"), "_change").alias("_held"))
    both = both.unionByName(asked.withColumns({"_row": F.lit(1), "_held": F.lit(None).cast(both.schema["_held"].dataType)}))
    tagged = with_bucket(both.join(F.broadcast(cut_points(both, "_at", [], buckets))), "_at", buckets)

    inside = W.partitionBy(*named, "_bucket").orderBy("_at", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = tagged.withColumn("_local", F.last("_held", ignorenulls=True).over(inside))
    ends = tagged.groupBy(*named, "_bucket").agg(F.max("_held").alias("_end"))
    earlier = W.partitionBy(*named).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*named, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    found = local.where("_row = 1").join(carried, [*by, "_bucket"]).select(*named, F.col("_at").alias(moment), F.coalesce("_local", "_carried").alias("_held"))
    joined = rows.join(found, [*by, moment], "left")
    picked = [F.col(f"_held._change.`{c}`").alias(c) for c in values]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_held.since").alias(since), *picked)


def threshold_in_force(
    scores: DataFrame, thresholds: DataFrame, moment: str, since: str, score: str = "churn_probability", version: str = "model_version", threshold: str = "decision_threshold",
    default: float = 0.5, tie_break: Sequence[str] = (),
) -> DataFrame:
    """Scores with the decision threshold that their model version had when they were made, and the class it gives; ``default`` where none is known."""
    held = asof_join(scores, thresholds, moment, since, [version], [threshold], tie_break)
    limit = F.coalesce(F.col(threshold), F.lit(float(default)))
    return held.withColumn(threshold, limit).withColumn("churn_prediction", over_threshold(F.col(score), F.col(threshold))).drop(since)


def with_marks(history: DataFrame, moment: str = "timestamp", flags: Sequence[str] = ("retrain_triggered", "champion_promoted")) -> DataFrame:
    """A check history with, for each flag, when it was last set at or before each check (``last_<flag>``): the marks of a trend."""
    out = history
    for flag in flags:
        name = f"last_{flag}"
        marks = history.where(F.coalesce(F.col(flag), F.lit(False))).select(F.col(moment).alias(name)).distinct()
        out = asof_join(out, marks, moment, name)
    return out
