"""Prediction log, delayed labels, history and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import labels as L
from holdfast.operators import metrics as M
from holdfast.operators import asof, policies, rules
from holdfast.plans import bindings as B
from holdfast.plans.bindings import AS_OF, sql_over
from holdfast.plans.registry import query, rounded
from holdfast.session import work_dir
from holdfast.sources import prediction_log as P
from holdfast.sources.tables import append_history


@query("labeled_join", sql_over("labeled", "SELECT prediction_id, prediction, churn FROM labeled"))
def labeled_join(spark, sf):
    return B.labeled_scores(spark, sf).select("prediction_id", F.col("churn_probability").alias("prediction"), "churn")


@query("attach_labels", sql_over("labels", "SELECT o_orderkey AS prediction_id, o_custkey, churn FROM orders LEFT JOIN labels ON prediction_id = o_orderkey"))
def attach_labels(spark, sf):
    rows = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("prediction_id"), "o_custkey", F.lit(9).alias("churn"))
    return L.attach_labels(rows, B.labels(spark, sf))


@query("latest_label", sql_over("labels", "SELECT prediction_id, churn, label_available_at::VARCHAR AS label_available_at FROM labels"))
def latest_label(spark, sf):
    return B.labels(spark, sf).withColumn("label_available_at", F.col("label_available_at").cast("string"))


def _pending(spark, sf):
    log = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prediction_id"), F.col("o_custkey").cast("string").alias("customerid"),
        F.col("o_totalprice").alias("MonthlyCharges"), F.to_date("o_orderdate").alias("day"),
    )
    raw = B.customers(spark, sf).select("customerID", "MonthlyCharges", "Churn")
    return L.pending_labels(log, raw, F.col("day"), 30).drop("day")


_PENDING = """pending AS (SELECT o_orderkey AS prediction_id, "customerID" AS customerid, o_totalprice AS "MonthlyCharges", "MonthlyCharges" AS "MonthlyCharges_raw",
CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS churn, o_orderdate::DATE AS simulation_day, o_orderdate::DATE + 30 AS label_available_day
FROM orders JOIN customers ON c_custkey = o_custkey)"""


@query(
    "pending_labels",
    sql_over(
        "customers",
        """SELECT prediction_id, customerid, "MonthlyCharges", round("MonthlyCharges_raw", 6) AS "MonthlyCharges_raw", churn, simulation_day, label_available_day FROM pending""",
        _PENDING,
    ),
)
def pending_labels(spark, sf):
    return rounded(_pending(spark, sf).select(
        "prediction_id", "customerid", "MonthlyCharges", "MonthlyCharges_raw", F.col("churn"), "simulation_day", "label_available_day"))


@query(
    "released_as_of",
    sql_over("customers", f"SELECT label_available_day, count(*) AS n, CAST(sum(churn) AS BIGINT) AS churned FROM pending WHERE label_available_day <= DATE '{AS_OF}' GROUP BY 1", _PENDING),
)
def released_as_of(spark, sf):
    due = L.released(_pending(spark, sf), F.lit(AS_OF).cast("date"), "label_available_day")
    return due.groupBy("label_available_day").agg(F.count("*").alias("n"), F.sum("churn").alias("churned"))


@query(
    "threshold_lookup",
    """SELECT o_orderkey AS prediction_id, coalesce(t, 0.5) AS decision_threshold, CASE WHEN ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE >= coalesce(t, 0.5) THEN 1 ELSE 0 END AS churn_prediction
    FROM orders LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS v, n_nationkey / 10.0::DOUBLE AS t FROM nation WHERE n_nationkey < 5) ON v = substr(o_orderpriority, 1, 1)""",
)
def threshold_lookup(spark, sf):
    """Threshold of the model version that made each prediction; 0.5 where the version is not known."""
    scores = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prediction_id"), F.substring("o_orderpriority", 1, 1).alias("model_version"),
        (((F.col("o_orderkey") * 7919) % 1000) / 1000.0).alias("p"),
    )
    models = B.table(spark, sf, "nation").where("n_nationkey < 5").select(
        F.col("n_nationkey").cast("string").alias("model_version"), (F.col("n_nationkey") / 10.0).alias("t")
    )
    joined = scores.join(models, "model_version", "left").withColumn("decision_threshold", F.coalesce("t", F.lit(0.5)))
    return joined.select("prediction_id", "decision_threshold", (F.col("p") >= F.col("decision_threshold")).cast("int").alias("churn_prediction"))


_CHANGES = """calls AS (SELECT event_id, user_id % 3 AS model_version, ts, value / 1000.0::DOUBLE AS p FROM events WHERE event_type <> 'purchase'),
changes AS (SELECT model_version, since, arg_max(t, event_id) AS t FROM (SELECT user_id % 3 AS model_version, ts AS since, event_id, (event_id * 37 % 100) / 100.0::DOUBLE AS t
FROM events WHERE event_type = 'purchase') GROUP BY model_version, since)"""


@query(
    "threshold_in_force",
    f"""WITH {_CHANGES} SELECT event_id, coalesce(t, 0.5) AS decision_threshold, CASE WHEN p >= coalesce(t, 0.5) THEN 1 ELSE 0 END AS churn_prediction
    FROM calls ASOF LEFT JOIN changes ON calls.model_version = changes.model_version AND calls.ts >= changes.since""",
)
def threshold_in_force(spark, sf):
    """Threshold that a model version had when each request was made; it changes with every purchase event."""
    events = B.table(spark, sf, "events").withColumn("model_version", F.col("user_id") % 3)
    calls = events.where("event_type <> 'purchase'").select("event_id", "model_version", "ts", (F.col("value") / 1000.0).alias("p"))
    changes = events.where("event_type = 'purchase'").select("model_version", F.col("ts").alias("since"), "event_id", (F.col("event_id") * 37 % 100 / 100.0).alias("decision_threshold"))
    held = asof.threshold_in_force(calls, changes.withColumnRenamed("event_id", "change_id"), "ts", "since", "p", tie_break=["change_id"])
    return held.select("event_id", "decision_threshold", "churn_prediction")


@query("log_readback", sql_over("log", "SELECT prediction_id, prediction, action FROM log WHERE request_id = 'req-19980115'"))
def log_readback(spark, sf):
    """The log is stored, one request is read back from it, and its row count checked."""
    path = work_dir(spark, "log")
    # Dated by month: the orders of the small tables are spread over thousands of days.
    P.append(B.prediction_log(spark, sf).withColumn("prediction_date", F.to_date(F.trunc("prediction_timestamp", "month"))), path)
    rows = P.read_request(spark, path, "req-19980115")
    P.check_request(rows, 1)
    return rows.select("prediction_id", "prediction", "action")


@query(
    "log_json",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, 'prediction_api' AS service, 'prod' AS environment, 'v7' AS model_version FROM orders""",
)
def log_json(spark, sf):
    """JSON lines of the log, read back by path."""
    rows = B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(0.5).alias("prediction"))
    lines = P.as_json(P.enrich(rows, "prod", model_version="v7", at=F.lit("2024-01-01").cast("timestamp")), ["o_orderkey", "o_orderstatus"])
    paths = {"order_id": "$.input.o_orderkey", "status": "$.input.o_orderstatus", "service": "$.service", "environment": "$.environment", "model_version": "$.model_version"}
    return lines.select(*[F.get_json_object("value", path).alias(name) for name, path in paths.items()])


@query(
    "union_batches",
    """SELECT event_id, value, user_id, source FROM (SELECT event_id, value, NULL::BIGINT AS user_id, 'a' AS source FROM events WHERE event_type = 'view'
    UNION ALL SELECT event_id, NULL::DOUBLE, user_id, 'b' FROM events WHERE event_type <> 'view')""",
)
def union_batches(spark, sf):
    e = B.table(spark, sf, "events")
    a = e.where("event_type = 'view'").select("event_id", "value", F.lit("a").alias("source"))
    b = e.where("event_type <> 'view'").select("event_id", "user_id", F.lit("b").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


# --- history and rules -------------------------------------------------------------------------------------


def history(spark, sf):
    """Performance history: one check per month of predictions."""
    rows = M.classification_metrics(B.labeled_scores(spark, sf), "churn", "churn_probability", 0.5, ["month"], numeric_target=True)
    return rows.select("month", "n_samples", F.col("f1").alias("f1_score"), "recall", "precision", "roc_auc", "brier_score")


_HISTORY = """ranked AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY p) + (count(*) OVER (PARTITION BY month, p) - 1) / 2.0 AS mid FROM pairs),
history AS (SELECT month, count(*) AS n_samples,
CASE WHEN sum(h) + sum(y) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(h * y) / (sum(h) + sum(y)) END AS f1_score,
CASE WHEN sum(y) = 0 THEN 0 ELSE sum(h * y)::DOUBLE / sum(y) END AS recall, CASE WHEN sum(h) = 0 THEN 0 ELSE sum(h * y)::DOUBLE / sum(h) END AS precision,
CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS roc_auc,
avg((p - y) * (p - y)) AS brier_score FROM (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h FROM ranked) GROUP BY month)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("f1_score", "recall", "precision", "roc_auc", "brier_score"))
_RULE = """decided AS (SELECT *, CASE WHEN n_samples < 20 THEN false WHEN f1_score < 0.6 THEN true WHEN recall < 0.65 THEN true WHEN roc_auc < 0.75 THEN true WHEN brier_score > 0.22 THEN true ELSE false END AS retrain,
CASE WHEN n_samples < 20 THEN 'Too few labels to judge by.' WHEN f1_score < 0.6 THEN 'F1' WHEN recall < 0.65 THEN 'Recall' WHEN roc_auc < 0.75 THEN 'ROC AUC' WHEN brier_score > 0.22 THEN 'Brier score' ELSE 'Every metric keeps its limit.' END AS cause FROM history)"""


def _cause():
    return F.regexp_replace("retrain_reason", " is [^,]*, limit .*", "")



@query("latest_metrics", sql_over("pairs", f"SELECT month, n_samples, {_ROUNDED} FROM history ORDER BY month DESC LIMIT 1", _HISTORY))
def latest_metrics(spark, sf):
    return rounded(rules.latest_row(history(spark, sf), "month"))


@query(
    "metric_trend",
    sql_over(
        "pairs",
        "SELECT month, n_samples, round(f1_score, 6) AS f1_score, round(f1_score - lag(f1_score) OVER (ORDER BY month), 6) AS f1_score_delta, round(brier_score - lag(brier_score) OVER (ORDER BY month), 6) AS brier_score_delta FROM history",
        _HISTORY,
    ),
)
def metric_trend(spark, sf):
    t = policies.trend(history(spark, sf), "month", ["f1_score", "brier_score"])
    return rounded(t.select("month", "n_samples", "f1_score", "f1_score_delta", "brier_score_delta"))


@query(
    "metric_marks",
    sql_over(
        "pairs",
        """SELECT month, retrain, max(CASE WHEN retrain THEN month END) OVER w AS last_retrain, max(CASE WHEN promoted THEN month END) OVER w AS last_promoted
        FROM (SELECT *, retrain AND n_samples % 2 = 0 AS promoted FROM decided) WINDOW w AS (ORDER BY month)""",
        f"{_HISTORY}, {_RULE}",
    ),
)
def metric_marks(spark, sf):
    """The last retraining and the last promotion before each check."""
    d = rules.retrain_decision(history(spark, sf)).select("month", "retrain", (F.col("retrain") & (F.col("n_samples") % 2 == 0)).alias("promoted"))
    # A history is a table of its own; checks are not computed again for each mark.
    d = append_history(d, work_dir(spark, "history"), moment=None)
    return asof.with_marks(d, "month", ["retrain", "promoted"]).select("month", "retrain", "last_retrain", "last_promoted")


@query("retrain_rule", sql_over("pairs", "SELECT month, n_samples, retrain, cause FROM decided", f"{_HISTORY}, {_RULE}"))
def retrain_rule(spark, sf):
    return rules.retrain_decision(history(spark, sf)).select("month", "n_samples", "retrain", _cause().alias("cause"))


@query(
    "run_strategy",
    sql_over(
        "pairs",
        """SELECT month, forced, CASE WHEN retrain THEN 'EMERGENCY' WHEN forced THEN 'FORCED' ELSE 'STABLE' END AS strategy, NOT retrain AND NOT forced AS skip,
        CASE WHEN NOT retrain THEN 'skipped' WHEN promoted THEN 'retrained_and_promoted' ELSE 'retrained_no_promotion' END AS outcome
        FROM (SELECT *, month LIKE '%-03' AS forced, n_samples % 2 = 0 AS promoted FROM decided)""",
        f"{_HISTORY}, {_RULE}",
    ),
)
def run_strategy(spark, sf):
    d = rules.retrain_decision(history(spark, sf)).withColumns({"forced": F.col("month").like("%-03"), "promoted": F.col("n_samples") % 2 == 0})
    drift, forced = F.col("retrain"), F.col("forced")
    return d.select(
        "month",
        "forced",
        rules.run_strategy(drift, forced).alias("strategy"),
        rules.skip_training(drift, forced).alias("skip"),
        rules.retrain_outcome(drift, F.col("promoted")).alias("outcome"),
    )


@query(
    "alerts",
    sql_over(
        "pairs",
        """SELECT month, severity, '[' || upper(severity) || '] Retraining for ' || month || chr(10) || cause AS text FROM (SELECT month, cause, CASE WHEN cause IN ('F1', 'Recall') THEN 'critical' ELSE 'warning' END AS severity FROM decided WHERE retrain)""",
        f"{_HISTORY}, {_RULE}",
    ),
)
def alerts(spark, sf):
    d = rules.retrain_decision(history(spark, sf)).withColumn("cause", _cause())
    severity = F.when(F.col("cause").isin("F1", "Recall"), "critical").otherwise("warning")
    return rules.alerts(d, F.col("retrain"), F.concat(F.lit("Retraining for "), F.col("month")), F.col("cause"), severity, ["month"])


@query(
    "model_compare",
    sql_over(
        "labels",
        """SELECT round(c, 6) AS champion_f1, 0.5::DOUBLE AS champion_decision_threshold, round(h, 6) AS challenger_f1, 0.4::DOUBLE AS challenger_decision_threshold, h > c AS is_better FROM (
        SELECT 2.0::DOUBLE * sum(y * a) / (sum(a) + sum(y)) AS c, 2.0::DOUBLE * sum(y * b) / (sum(b) + sum(y)) AS h FROM (SELECT churn AS y,
        CASE WHEN ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS a, CASE WHEN ((o_orderkey * 104729) % 1000) / 1000.0::DOUBLE >= 0.4 THEN 1 ELSE 0 END AS b
        FROM orders JOIN labels ON prediction_id = o_orderkey))""",
    ),
)
def model_compare(spark, sf):
    rows = B.labeled_scores(spark, sf).withColumn("challenger", ((F.col("prediction_id") * 104729) % 1000) / 1000.0)
    return rounded(rules.compare_models(rows, "churn", {"champion": ("churn_probability", 0.5), "challenger": ("challenger", 0.4)}))


@query(
    "alias_latest",
    """SELECT alias, event_id AS version, ts::VARCHAR AS assigned_at FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY ts DESC, event_id DESC) AS rn FROM (
    SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'champion' WHEN 1 THEN 'challenger' ELSE 'shadow' END AS alias FROM events)) WHERE rn = 1 AND alias <> 'shadow'""",
)
def alias_latest(spark, sf):
    third = F.col("user_id") % 3
    rows = B.table(spark, sf, "events").select(
        F.when(third == 0, "champion").when(third == 1, "challenger").otherwise("shadow").alias("alias"),
        F.col("event_id").alias("version"),
        F.col("ts").alias("assigned_at"),
    )
    return rules.latest_aliases(rows).withColumn("assigned_at", F.col("assigned_at").cast("string"))
