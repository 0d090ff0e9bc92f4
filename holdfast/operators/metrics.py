"""Classification, calibration, ranking and business metrics of labeled predictions.

Everything that depends on (score, label) is computed from one collapsed score table, so a full report reads
its input once and shuffles one row per distinct score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.config import DecisionSettings
from holdfast.functions.scalars import clip, drop_nan, strict_binary_target
from holdfast.operators.ordering import collapse, running_totals
from holdfast.operators.validation import require_columns

# Fixed value: distance from 0 and 1 at which log loss clips a probability.
LOG_LOSS_EPS = 2.220446049250313e-16
# 81 candidate thresholds from 0.10 to 0.90, as numpy's arange spaces them in double arithmetic.
THRESHOLD_GRID = tuple(0.10 + i * ((0.10 + 0.01) - 0.10) for i in range(81))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def labeled_rows(df: DataFrame, y_true: str, y_score: str, extra: Sequence[str] = (), numeric_target: bool = False) -> DataFrame:
    """Rows with label, score and the extra columns present; label as 0/1 ``y``, score clipped as ``p``."""
    require_columns(df, [y_true, y_score, *extra])
    keep = F.col(y_true).isNotNull() & drop_nan(F.col(y_score)).isNotNull()
    for name in extra:
        keep = keep & F.col(name).isNotNull()
    return (
        df.where(keep)
        .withColumn("y", strict_binary_target(F.col(y_true), numeric_target))
        .withColumn("p", clip(F.col(y_score).cast("double")))
    )


def confusion_columns(y: Column, predicted: Column, weight: Column | None = None) -> dict[str, Column]:
    weight = F.lit(1) if weight is None else weight

    def cell(actual: int, guess: int) -> Column:
        return F.coalesce(F.sum(F.when((y == actual) & (predicted == guess), weight)), F.lit(0)).cast("bigint")

    return {
        "true_negatives": cell(0, 0),
        "false_positives": cell(0, 1),
        "false_negatives": cell(1, 0),
        "true_positives": cell(1, 1),
    }


def confusion(labeled: DataFrame, threshold: float | Column = 0.5, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of :func:`labeled_rows` at a threshold, overall or by group."""
    predicted = (F.col("p") >= threshold).cast("int")
    cells = confusion_columns(F.col("y"), predicted)
    return labeled.groupBy(*groups).agg(*[c.alias(n) for n, c in cells.items()])


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from confusion counts."""
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
    }


def with_rates(counts: DataFrame) -> DataFrame:
    cells = [F.col(n) for n in ("true_negatives", "false_positives", "false_negatives", "true_positives")]
    return counts.select("*", *[c.alias(n) for n, c in rates(*cells).items()])


# --- score table -------------------------------------------------------------------------------------------


def score_table(labeled: DataFrame, groups: Sequence[str] = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct score with its positives and negatives (and further sums)."""
    parts = {"pos": F.col("y"), "neg": 1 - F.col("y"), **(sums or {})}
    return collapse(labeled, "p", parts, groups)


def ranked_scores(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Score table with running and total positives and negatives in ascending score order."""
    return running_totals(scores, "p", ["pos", "neg"], groups)


def _one_class_null(metric: Column) -> Column:
    return F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), metric)


def roc_auc() -> Column:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    below = F.col("cum_neg") - F.col("neg")
    pairs = F.sum(F.col("pos") * (below.cast("double") + F.col("neg") / 2.0))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return _one_class_null(F.try_divide(pairs, total))


def average_precision() -> Column:
    """Step sum of precision over recall, from the highest score down."""
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    return _one_class_null(F.try_divide(F.sum(F.col("pos") * ratio(tp, tp + fp)), F.sum("pos").cast("double")))


def log_loss() -> Column:
    q = clip(F.col("p"), LOG_LOSS_EPS, 1 - LOG_LOSS_EPS)
    loss = -(F.sum(F.col("pos") * F.ln(q)) + F.sum(F.col("neg") * F.ln(1 - q)))
    return _one_class_null(F.try_divide(loss, F.sum(F.col("pos") + F.col("neg")).cast("double")))


def brier_score() -> Column:
    error = F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p"))
    return F.try_divide(error, F.sum(F.col("pos") + F.col("neg")).cast("double"))


#: Metrics of a report by name: each builds an aggregate over the score table (p, pos, neg, and the running totals cum_* and all_*). Add to this table to extend every report.
SCORE_METRICS: dict[str, Callable[[], Column]] = {}


def score_metric(name: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Register a metric for all reports. It is read from the same rows as the others, so it costs no scan of its own."""

    def register(build: Callable[[], Column]) -> Callable[[], Column]:
        SCORE_METRICS[name] = build
        return build

    return register


def safe_metric(build: Callable[[], Column]) -> Column:
    """The metric, or a missing value where it cannot be built (``ValueError``) or the batch has one class only."""
    try:
        return _one_class_null(build()).cast("double")
    except ValueError:
        return F.lit(None).cast("double")


def classification_report_row(
    ranked: DataFrame, threshold: float, groups: Sequence[str] = (), extra: Sequence[Column] = (), metrics: dict[str, Callable[[], Column]] | None = None
) -> DataFrame:
    """The full metric row from :func:`ranked_scores`, with the registered ``SCORE_METRICS`` and those in ``metrics``.

    An empty input gives an error, as a report on nothing would lie."""
    own = {**SCORE_METRICS, **(metrics or {})}
    n = F.sum(F.col("pos") + F.col("neg"))
    high = F.col("p") >= threshold
    cells = {
        "true_negatives": F.sum(F.when(~high, F.col("neg")).otherwise(0)),
        "false_positives": F.sum(F.when(high, F.col("neg")).otherwise(0)),
        "false_negatives": F.sum(F.when(~high, F.col("pos")).otherwise(0)),
        "true_positives": F.sum(F.when(high, F.col("pos")).otherwise(0)),
    }
    missing = F.raise_error(F.lit("Every row lacks a label or a score.")).cast("bigint")
    rows = ranked.groupBy(*groups).agg(
        F.when(n > 0, n).otherwise(missing).alias("n_samples"),
        F.lit(float(threshold)).alias("threshold"),
        *[c.cast("bigint").alias(name) for name, c in cells.items()],
        roc_auc().alias("roc_auc"),
        average_precision().alias("pr_auc"),
        log_loss().alias("log_loss"),
        brier_score().alias("brier_score"),
        (F.sum(F.when(high, F.col("pos") + F.col("neg")).otherwise(0)) / n).alias("predicted_churn_rate"),
        (F.sum("pos") / n).alias("actual_churn_rate"),
        (F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / n).alias("avg_churn_probability"),
        *[safe_metric(build).alias(name) for name, build in own.items()],
        *extra,
    )
    return with_rates(rows)


def classification_metrics(
    df: DataFrame,
    y_true: str = "Churn",
    y_score: str = "churn_probability",
    threshold: float = 0.5,
    groups: Sequence[str] = (),
    numeric_target: bool = False,
    metrics: dict[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """All classification metrics of a labeled batch in one row (or one per group), and any of the caller's ``metrics`` (see ``SCORE_METRICS``)."""
    labeled = labeled_rows(df, y_true, y_score, groups, numeric_target)
    return classification_report_row(ranked_scores(score_table(labeled, groups), groups), threshold, groups, metrics=metrics)


def roc_points(ranked: DataFrame) -> DataFrame:
    """One ROC point per distinct score, highest score first in meaning: rates at ``score >= threshold``."""
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    return ranked.select(
        F.col("p").alias("threshold"), ratio(fp, F.col("all_neg")).alias("fpr"), ratio(tp, F.col("all_pos")).alias("tpr")
    )


def class_report(labeled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support by class, with the macro and weighted averages."""
    counts = confusion(labeled, threshold)
    tn, fp, fn, tp = (F.col(n) for n in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    n = tn + fp + fn + tp

    def one(name: str, hit: Column, wrong_in: Column, missed: Column) -> dict[str, Column]:
        return {
            "label": F.lit(name),
            "precision": ratio(hit, hit + wrong_in),
            "recall": ratio(hit, hit + missed),
            "f1": ratio(hit * 2, hit * 2 + wrong_in + missed),
            "support": hit + missed,
        }

    zero, one_ = one("0", tn, fn, fp), one("1", tp, fp, fn)
    names = ("precision", "recall", "f1")
    macro = {"label": F.lit("macro avg"), **{m: (zero[m] + one_[m]) / 2 for m in names}, "support": n}
    weighted = {
        "label": F.lit("weighted avg"),
        **{m: ratio(zero[m] * zero["support"] + one_[m] * one_["support"], n) for m in names},
        "support": n,
    }
    accuracy = {"label": F.lit("accuracy"), **{m: ratio(tn + tp, n) for m in names}, "support": n}
    rows = F.array(*[F.struct(*[c.alias(k) for k, c in r.items()]) for r in (zero, one_, accuracy, macro, weighted)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def best_threshold(labeled: DataFrame, grid: Sequence[float] = THRESHOLD_GRID, groups: Sequence[str] = ()) -> DataFrame:
    """Threshold of the grid with the highest F1, the first one on ties.

    Each row is reduced to the number of grid values its score reaches, so at most ``len(grid) + 1`` rows per
    group remain, and the counts at a threshold are a suffix sum over them.
    """
    splits = [float("-inf"), *grid, float("inf")]
    binned = Bucketizer(splits=splits, inputCol="p", outputCol="_bin").transform(labeled)
    bins = binned.groupBy(*groups, F.col("_bin").cast("int").alias("_bin")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    # All thresholds between two neighbouring bins give the same counts, so each bin stands for the lowest of them.
    down = W.partitionBy(*groups).orderBy(F.desc("_bin"))
    upto = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    lowest = F.coalesce(F.lead("_bin").over(down), F.lit(0))
    tp, fp = F.sum("pos").over(upto), F.sum("neg").over(upto)
    f1 = ratio(tp * 2, tp + fp + F.sum("pos").over(W.partitionBy(*groups)))
    # Rows below the first threshold stand for it only when no other row does; its F1 is then 0.
    below = F.col("_bin") == 0
    candidates = bins.select(
        *groups, F.when(below, 0.0).otherwise(f1).alias("f1"), F.when(below, 0).otherwise(lowest).alias("i")
    )
    best = candidates.groupBy(*groups).agg(F.max(F.struct("f1", (-F.col("i")).alias("order"))).alias("b"))
    values = F.array(*[F.lit(float(t)) for t in grid])
    return best.select(
        *groups, F.get(values, -F.col("b.order")).alias("best_threshold"), F.col("b.f1").alias("best_f1")
    )


# --- business metrics --------------------------------------------------------------------------------------


def action_cost(action: Column, s: DecisionSettings) -> Column:
    return F.when(action == "send_email", s.cost_contact).when(action == "offer_discount", s.cost_discount).otherwise(0.0)


def action_uplift(action: Column, s: DecisionSettings) -> Column:
    return F.when(action == "send_email", s.contact_uplift).when(action == "offer_discount", s.discount_uplift).otherwise(0.0)


def business_columns(action: Column, value: Column, s: DecisionSettings) -> dict[str, Column]:
    """Per-row money columns of labeled rows (``y`` and ``p``)."""
    cost, saved = action_cost(action, s), value * action_uplift(action, s)
    acted = (action != "no_action").cast("bigint")
    realized = F.col("y") * saved
    return {
        "acted": acted,
        "emails": (action == "send_email").cast("bigint"),
        "discounts": (action == "offer_discount").cast("bigint"),
        "cost": cost,
        "expected_saved": F.col("p") * saved,
        "realized_saved": realized,
        "acted_churners": acted * F.col("y"),
        "acted_realized": F.when(acted == 1, realized - cost).otherwise(0.0),
    }


def business_report(sums: dict[str, Column], n: Column, prefix: str = "") -> list[Column]:
    """The thirteen business fields from the sums of :func:`business_columns`."""
    expected = sums["expected_saved"] - sums["cost"]
    realized = sums["realized_saved"] - sums["cost"]
    fields = {
        "n_samples": n,
        "intervention_rate": ratio(sums["acted"], n),
        "send_email_rate": ratio(sums["emails"], n),
        "offer_discount_rate": ratio(sums["discounts"], n),
        "total_intervention_cost": sums["cost"],
        "expected_saved_value": sums["expected_saved"],
        "expected_profit": expected,
        "avg_expected_profit_per_customer": ratio(expected, n),
        "actual_intervened_churners": sums["acted_churners"],
        "realized_saved_value": sums["realized_saved"],
        "realized_profit": realized,
        "avg_realized_profit_per_customer": ratio(realized, n),
        "realized_profit_per_action": ratio(sums["acted_realized"], sums["acted"]),
    }
    return [c.alias(prefix + name) for name, c in fields.items()]


def business_metrics(
    df: DataFrame,
    y_true: str = "Churn",
    y_score: str = "churn_probability",
    action: str = "action",
    value: str | None = "customer_value",
    settings: DecisionSettings = DecisionSettings(),
    groups: Sequence[str] = (),
    numeric_target: bool = False,
) -> DataFrame:
    """Cost, expected and realized value of the actions taken. The row's own value is used when it has one."""
    labeled = labeled_rows(df, y_true, y_score, [action, *groups], numeric_target)
    worth = F.col(value).cast("double") if value and value in df.columns else F.lit(settings.customer_value)
    parts = business_columns(F.col(action), worth, settings)
    sums = {name: F.sum(c) for name, c in parts.items()}
    return labeled.groupBy(*groups).agg(*business_report(sums, F.count("*")))


_STATE_SUMS = ("pos", "neg", "acted", "emails", "discounts", "cost", "expected_saved", "realized_saved", "acted_churners", "acted_realized", "own_expected")


def metric_state(
    df: DataFrame,
    y_true: str,
    y_score: str,
    action: str,
    moment: str,
    expected_value: str,
    settings: DecisionSettings = DecisionSettings(),
    value: str | None = "customer_value",
    groups: Sequence[str] = (),
    numeric_target: bool = True,
) -> DataFrame:
    """All that a report needs of labeled predictions, one row per distinct score: counts, money sums and the first and last moment. States of
    separate rows can be kept and merged (:func:`merge_states`) instead of the rows."""
    labeled = labeled_rows(df, y_true, y_score, [action, *groups], numeric_target)
    worth = F.col(value).cast("double") if value and value in df.columns else F.lit(settings.customer_value)
    parts = {"pos": F.col("y"), "neg": 1 - F.col("y"), **business_columns(F.col(action), worth, settings)}
    parts["own_expected"] = F.coalesce(F.col(expected_value).cast("double"), F.lit(0.0))
    return labeled.groupBy(*groups, "p").agg(*[F.sum(parts[n]).alias(n) for n in _STATE_SUMS], F.min(moment).alias("first_at"), F.max(moment).alias("last_at"))


def merge_states(states: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Several states as one."""
    sums = [F.sum(n).alias(n) for n in _STATE_SUMS]
    return states.groupBy(*groups, "p").agg(*sums, F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def report_of_state(state: DataFrame, threshold: float, groups: Sequence[str] = ()) -> DataFrame:
    """The monitoring row of a state: window, classification, calibration, ranking and business fields."""
    # True for every row; naming all sums keeps the shuffle identical in the branches that read it.
    keep = F.col("first_at").isNotNull() | F.col("last_at").isNotNull()
    for name in _STATE_SUMS:
        keep = keep | (F.col(name) != 0)
    ranked = ranked_scores(state.where(keep), groups)
    sums = {name: F.sum(name) for name in _STATE_SUMS}
    n = F.sum(F.col("pos") + F.col("neg"))
    row = classification_report_row(
        ranked,
        threshold,
        groups,
        [
            F.min("first_at").alias("window_start"),
            F.max("last_at").alias("window_end"),
            sums["own_expected"].alias("expected_profit"),
            *business_report(sums, n, "business_"),
        ],
    )
    return row.withColumnsRenamed(
        {
            "f1": "f1_score",
            "threshold": "decision_threshold",
            "predicted_churn_rate": "high_risk_share",
            "actual_churn_rate": "churn_rate",
        }
    )


def performance_row(
    df: DataFrame,
    y_true: str,
    y_score: str,
    action: str,
    moment: str,
    expected_value: str,
    threshold: float,
    settings: DecisionSettings = DecisionSettings(),
    value: str | None = "customer_value",
    groups: Sequence[str] = (),
    numeric_target: bool = True,
) -> DataFrame:
    """Monitoring row of joined predictions. Business sums ride on the score table, so the joined input is still read once."""
    return report_of_state(metric_state(df, y_true, y_score, action, moment, expected_value, settings, value, groups, numeric_target), threshold, groups)
