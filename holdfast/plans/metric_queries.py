"""Classification, ranking and business metrics of labeled predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import metrics as M
from holdfast.operators.decisions import customer_value, decide_each
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded

_CELLS = """CAST(count(*) FILTER (y = 0 AND p < {t}) AS BIGINT) AS true_negatives, CAST(count(*) FILTER (y = 0 AND p >= {t}) AS BIGINT) AS false_positives,
CAST(count(*) FILTER (y = 1 AND p < {t}) AS BIGINT) AS false_negatives, CAST(count(*) FILTER (y = 1 AND p >= {t}) AS BIGINT) AS true_positives"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


_TN, _FP, _FN, _TP = "true_negatives", "false_positives", "false_negatives", "true_positives"
_RATES = {
    "accuracy": _ratio(f"{_TP} + {_TN}", f"{_TP} + {_TN} + {_FP} + {_FN}"),
    "precision": _ratio(_TP, f"{_TP} + {_FP}"),
    "recall": _ratio(_TP, f"{_TP} + {_FN}"),
    "f1": _ratio(f"2 * {_TP}", f"2 * {_TP} + {_FP} + {_FN}"),
}
_RATE_SQL = ", ".join(f"round({e}, 6) AS {n}" for n, e in _RATES.items())

# Ranks over single rows: an independent way to the numbers the score table gives.
_RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS mid,
 count(*) OVER (PARTITION BY g ORDER BY p DESC) AS above, sum(y) OVER (PARTITION BY g ORDER BY p DESC) AS hits FROM grouped)"""
_AUC = """CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
 / (sum(y)::DOUBLE * (count(*) - sum(y))) END"""
_AP = "CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN sum(CASE WHEN y = 1 THEN hits::DOUBLE / above ELSE 0 END) / sum(y) END"
_EPS = "2.220446049250313e-16::DOUBLE"
_CLIPPED = f"least(greatest(p, {_EPS}), 1 - {_EPS})"
_LOG_LOSS = f"CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN avg(-(y * ln({_CLIPPED}) + (1 - y) * ln(1 - {_CLIPPED}))) END"
_BRIER = "avg((p - y) * (p - y))"


def _pairs(spark, sf, groups=()):
    return M.labeled_rows(B.labeled_scores(spark, sf), "churn", "churn_probability", groups, numeric_target=True)


def _ranked(spark, sf):
    return M.ranked_scores(M.score_table(_pairs(spark, sf)))


@query("confusion", sql_over("pairs", f"SELECT {_CELLS.format(t='0.5')} FROM pairs"))
def confusion(spark, sf):
    return M.confusion(_pairs(spark, sf))


@query(
    "classification_metrics",
    sql_over(
        "pairs",
        f"""SELECT n_samples, {_TN}, {_FP}, {_FN}, {_TP}, {_RATE_SQL}, round(pr, 6) AS predicted_churn_rate, round(ar, 6) AS actual_churn_rate,
        round(ap, 6) AS avg_churn_probability, round(auc, 6) AS roc_auc, round(avp, 6) AS pr_auc, round(ll, 6) AS log_loss, round(bs, 6) AS brier_score
        FROM (SELECT count(*) AS n_samples, {_CELLS.format(t="0.5")}, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS pr, avg(y) AS ar, avg(p) AS ap,
        {_AUC} AS auc, {_AP} AS avp, {_LOG_LOSS} AS ll, {_BRIER} AS bs FROM ranked)""",
        "grouped AS (SELECT *, 1 AS g FROM pairs), " + _RANKED,
    ),
)
def classification_metrics(spark, sf):
    df = M.classification_metrics(B.labeled_scores(spark, sf), "churn", "churn_probability", 0.5, numeric_target=True)
    return rounded(df.drop("threshold"))


@query(
    "roc_auc",
    sql_over(
        "pairs", f"SELECT model_version, round({_AUC}, 6) AS roc_auc FROM ranked GROUP BY model_version", "grouped AS (SELECT *, model_version AS g FROM pairs), " + _RANKED
    ),
)
def roc_auc(spark, sf):
    by = ["model_version"]
    ranked = M.ranked_scores(M.score_table(_pairs(spark, sf, by), by), by)
    return rounded(ranked.groupBy(*by).agg(M.roc_auc().alias("roc_auc")))


@query(
    "average_precision",
    sql_over(
        "pairs", f"SELECT model_version, round({_AP}, 6) AS pr_auc FROM ranked GROUP BY model_version", "grouped AS (SELECT *, model_version AS g FROM pairs), " + _RANKED
    ),
)
def average_precision(spark, sf):
    by = ["model_version"]
    ranked = M.ranked_scores(M.score_table(_pairs(spark, sf, by), by), by)
    return rounded(ranked.groupBy(*by).agg(M.average_precision().alias("pr_auc")))


@query("log_loss_brier", sql_over("pairs", f"SELECT round({_LOG_LOSS}, 6) AS log_loss, round({_BRIER}, 6) AS brier_score FROM pairs"))
def log_loss_brier(spark, sf):
    scores = M.score_table(_pairs(spark, sf))
    return rounded(scores.agg(M.log_loss().alias("log_loss"), M.brier_score().alias("brier_score")))


@query(
    "roc_curve",
    sql_over(
        "pairs",
        """SELECT a.p AS threshold, round(sum(b.neg)::DOUBLE / max(t.n), 6) AS fpr, round(sum(b.pos)::DOUBLE / max(t.p), 6) AS tpr
        FROM s a JOIN s b ON b.p >= a.p CROSS JOIN (SELECT sum(pos) AS p, sum(neg) AS n FROM s) t GROUP BY a.p""",
        "s AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM pairs GROUP BY p)",
    ),
)
def roc_curve(spark, sf):
    return rounded(M.roc_points(_ranked(spark, sf)))


@query(
    "classification_report",
    sql_over(
        "pairs",
        """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
        SELECT label, precision, recall, f1, support FROM per
        UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM (SELECT (SELECT count(*) FROM d WHERE y = h)::DOUBLE / (SELECT count(*) FROM d) AS acc, (SELECT count(*) FROM d) AS n)
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per)""",
        """d AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM pairs),
        per AS (SELECT CAST(c AS VARCHAR) AS label, count(*) FILTER (y = c AND h = c)::DOUBLE / count(*) FILTER (h = c) AS precision,
        count(*) FILTER (y = c AND h = c)::DOUBLE / count(*) FILTER (y = c) AS recall,
        2.0 * count(*) FILTER (y = c AND h = c) / (count(*) FILTER (h = c) + count(*) FILTER (y = c)) AS f1, count(*) FILTER (y = c) AS support
        FROM d CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) GROUP BY c)""",
    ),
)
def classification_report(spark, sf):
    return rounded(M.class_report(_pairs(spark, sf)))


@query(
    "one_class_guard",
    sql_over(
        "pairs",
        f"""SELECT batch, {_AUC} AS roc_auc, {_AP} AS pr_auc, {_LOG_LOSS} AS log_loss, CAST(count(*) AS BIGINT) AS n FROM ranked GROUP BY batch""",
        "grouped AS (SELECT *, CASE WHEN y = 1 THEN 'churned' ELSE 'stayed' END AS batch, CASE WHEN y = 1 THEN 'churned' ELSE 'stayed' END AS g FROM pairs), " + _RANKED,
    ),
)
def one_class_guard(spark, sf):
    """Batches with a single class have no ranking metrics."""
    batches = B.labeled_scores(spark, sf).withColumn("batch", F.when(F.col("churn") == 1, "churned").otherwise("stayed"))
    by = ["batch"]
    labeled = M.labeled_rows(batches, "churn", "churn_probability", by, numeric_target=True)
    ranked = M.ranked_scores(M.score_table(labeled, by), by)
    return ranked.groupBy(*by).agg(
        M.roc_auc().alias("roc_auc"), M.average_precision().alias("pr_auc"), M.log_loss().alias("log_loss"), F.sum(F.col("pos") + F.col("neg")).alias("n")
    )


@query(
    "best_threshold",
    sql_over(
        "pairs",
        """SELECT model_version, round(t, 6) AS best_threshold, round(f1, 6) AS best_f1 FROM (
        SELECT model_version, t, f1, row_number() OVER (PARTITION BY model_version ORDER BY f1 DESC, t) AS rn FROM (
        SELECT model_version, t, CASE WHEN sum(h) + sum(y) = 0 THEN 0 ELSE 2.0 * sum(h * y) / (sum(h) + sum(y)) END AS f1
        FROM (SELECT model_version, t, y, CASE WHEN p >= t THEN 1 ELSE 0 END AS h FROM pairs CROSS JOIN grid) GROUP BY model_version, t)) WHERE rn = 1""",
        "grid AS (SELECT 0.1::DOUBLE + i * ((0.1::DOUBLE + 0.01::DOUBLE) - 0.1::DOUBLE) AS t FROM range(81) r(i))",
    ),
)
def best_threshold(spark, sf):
    return rounded(M.best_threshold(_pairs(spark, sf, ["model_version"]), groups=["model_version"]))


_MONEY = """m AS (SELECT *, CASE action WHEN 'send_email' THEN 2.0::DOUBLE WHEN 'offer_discount' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS cost,
customer_value * CASE action WHEN 'send_email' THEN 0.1::DOUBLE WHEN 'offer_discount' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS saved FROM labeled)"""
_BUSINESS = {
    "n_samples": "count(*)",
    "intervention_rate": "round(avg(CASE WHEN action <> 'no_action' THEN 1.0 ELSE 0.0 END), 6)",
    "send_email_rate": "round(avg(CASE WHEN action = 'send_email' THEN 1.0 ELSE 0.0 END), 6)",
    "offer_discount_rate": "round(avg(CASE WHEN action = 'offer_discount' THEN 1.0 ELSE 0.0 END), 6)",
    "total_intervention_cost": "round(sum(cost), 3)",
    "expected_saved_value": "round(sum(prediction * saved), 3)",
    "expected_profit": "round(sum(prediction * saved - cost), 3)",
    "avg_expected_profit_per_customer": "round(avg(prediction * saved - cost), 6)",
    "actual_intervened_churners": "CAST(count(*) FILTER (action <> 'no_action' AND churn = 1) AS BIGINT)",
    "realized_saved_value": "round(sum(churn * saved), 3)",
    "realized_profit": "round(sum(churn * saved - cost), 3)",
    "avg_realized_profit_per_customer": "round(avg(churn * saved - cost), 6)",
    "realized_profit_per_action": "round(avg(CASE WHEN action <> 'no_action' THEN churn * saved - cost END), 6)",
}
_MONEY_COLUMNS = ("total_intervention_cost", "expected_saved_value", "expected_profit", "realized_saved_value", "realized_profit")


def _business_sql(prefix: str = "") -> str:
    return ", ".join(f"{e} AS {prefix}{n}" for n, e in _BUSINESS.items())


def _money_rounded(df, prefix=""):
    return rounded(df, expected_profit=3, **{prefix + c: 3 for c in _MONEY_COLUMNS if prefix + c != "expected_profit"})


@query("business_metrics", sql_over("labeled", f"SELECT {_business_sql()} FROM m", _MONEY))
def business_metrics(spark, sf):
    df = M.business_metrics(B.labeled_log(spark, sf), "churn", "churn_probability", settings=B.SETTINGS, numeric_target=True)
    return _money_rounded(df)


@query(
    "batch_report",
    sql_over(
        "labeled",
        f"""SELECT CAST(ws AS VARCHAR) AS window_start, CAST(we AS VARCHAR) AS window_end, n_samples, {_TN}, {_FP}, {_FN}, {_TP},
        {_RATE_SQL.replace("AS f1", "AS f1_score")}, round(hr, 6) AS high_risk_share, round(cr, 6) AS churn_rate, round(ap, 6) AS avg_churn_probability,
        round(auc, 6) AS roc_auc, round(avp, 6) AS pr_auc, round(ll, 6) AS log_loss, round(bs, 6) AS brier_score, round(ep, 3) AS expected_profit, {", ".join("business_" + n for n in _BUSINESS)}
        FROM (SELECT min(prediction_timestamp) AS ws, max(prediction_timestamp) AS we, {_CELLS.format(t="0.5")}, count(*) AS n_samples, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS hr, avg(y) AS cr, avg(p) AS ap,
        {_AUC} AS auc, {_AP} AS avp, {_LOG_LOSS} AS ll, {_BRIER} AS bs, sum(expected_value) AS ep, {_business_sql("business_")} FROM ranked)""",
        _MONEY + ", grouped AS (SELECT *, prediction AS p, churn AS y, 1 AS g FROM m), " + _RANKED,
    ),
)
def batch_report(spark, sf):
    log = B.labeled_log(spark, sf)
    row = M.performance_row(log, "churn", "churn_probability", "action", "prediction_timestamp", "expected_value", 0.5, B.SETTINGS)
    row = row.drop("decision_threshold").withColumns(
        {c: F.col(c).cast("string") for c in ("window_start", "window_end")}
    )
    return _money_rounded(row, "business_")


@query(
    "flagship_labeled_profit",
    sql_over(
        "labeled",
        f"""SELECT action, n_samples, {_TN}, {_FP}, {_FN}, {_TP}, {_RATE_SQL}, total_intervention_cost, expected_profit, realized_profit, realized_profit_per_action
        FROM (SELECT action, count(*) AS n_samples, {_CELLS.format(t="0.5").replace("p <", "prediction <").replace("p >=", "prediction >=").replace("y =", "churn =")},
        round(sum(cost), 3) AS total_intervention_cost, round(sum(prediction * saved - cost), 3) AS expected_profit, round(sum(churn * saved - cost), 3) AS realized_profit,
        round(coalesce(avg(CASE WHEN action <> 'no_action' THEN churn * saved - cost END), 0.0), 6) AS realized_profit_per_action FROM m GROUP BY action)""",
        _MONEY,
    ),
)
def flagship_labeled_profit(spark, sf):
    """Which labeled predictions were right, and what did the actions earn?"""
    labeled = M.labeled_rows(B.labeled_log(spark, sf), "churn", "churn_probability", ["action"], numeric_target=True)
    parts = M.business_columns(F.col("action"), F.col("customer_value"), B.SETTINGS)
    sums = {n: F.sum(c) for n, c in parts.items()}
    cells = M.confusion_columns(F.col("y"), (F.col("p") >= 0.5).cast("int"))
    wanted = ("n_samples", *_MONEY_COLUMNS, "realized_profit_per_action")
    report = [c for c in M.business_report(sums, F.count("*"))]
    grouped = labeled.groupBy("action").agg(*report, *[c.alias(n) for n, c in cells.items()])
    rows = M.with_rates(grouped.select("action", *wanted, *cells))
    return _money_rounded(rows).drop("expected_saved_value", "realized_saved_value")


@query(
    "customer_value",
    sql_over("customers valued", 'SELECT "customerID", round(customer_value, 6) AS customer_value FROM customers JOIN valued USING (c_custkey)'),
)
def customer_value_query(spark, sf):
    c = B.customers(spark, sf)
    return rounded(c.select("customerID", customer_value(c, 100.0, "MonthlyCharges", "tenure").alias("customer_value")))


@query(
    "single_decision",
    sql_over("log", "SELECT prediction_id, action, round(expected_value, 6) AS expected_value FROM log"),
)
def single_decision(spark, sf):
    return rounded(decide_each(B.scored_orders(spark, sf), s=B.SETTINGS).select("prediction_id", "action", "expected_value"))
