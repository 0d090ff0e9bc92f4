"""The logical tables of the engine, bound to the star-schema test tables, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import DecisionSettings
from holdfast.operators.decisions import customer_value, decide_each
from holdfast.operators.labels import labeled_predictions, latest_labels

SETTINGS = DecisionSettings(max_discount_budget=200.0)
RATE_SETTINGS = DecisionSettings(max_discount_budget=None)
TIE_BREAK = ("l_linenumber", "l_partkey", "l_suppkey")
AS_OF = "2000-06-30"


# Declared types, so that opening a table needs no job to look at its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with tenure, charges and churn derived from their orders."""
    span = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min("o_orderdate").alias("first_order"),
            F.max("o_orderdate").alias("last_order"),
            F.count("*").alias("n_orders"),
            F.sum(F.col("o_totalprice").cast("decimal(28,2)")).cast("decimal(28,2)").alias("total"),
        )
    )
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    # A customer without orders has no tenure and no charges, and stays.
    joined = table(spark, sf, "customer").join(span, "c_custkey", "left").join(nations, "c_nationkey", "left")
    return joined.select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("customerID"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("bigint").alias("SeniorCitizen"),
        F.when(F.col("c_acctbal") < 5000, "Yes").otherwise("No").alias("Partner"),
        F.when(F.col("c_nationkey") % 3 == 0, "Month-to-month").when(F.col("c_nationkey") % 3 == 1, "One year").otherwise("Two year").alias("Contract"),
        F.when(F.col("n_regionkey") < 2, "DSL").when(F.col("n_regionkey") < 4, "Fiber optic").otherwise("No").alias("InternetService"),
        F.col("c_mktsegment").alias("PaymentMethod"),
        F.expr("coalesce(CAST(datediff(last_order, first_order) div 30 AS BIGINT), 0L)").alias("tenure"),
        F.coalesce(F.col("total").cast("double") / F.col("n_orders") / 10000, F.lit(0.0)).alias("MonthlyCharges"),
        F.when(F.col("c_custkey") % 97 == 0, " ").otherwise(F.coalesce(F.col("total").cast("string"), F.lit("0.00"))).alias("TotalCharges"),
        F.when(F.col("last_order") < F.lit("2001-01-01").cast("timestamp_ntz"), "Yes").otherwise("No").alias("Churn"),
    )


def contract_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All 21 contract columns, some with values the contract rejects, in batches by customer number."""
    c = customers(spark, sf)
    k = F.col("c_custkey")
    return c.select(
        (k % 40).alias("batch_id"),
        F.when(k % 331 != 0, F.col("customerID")).alias("customerID"),
        F.when(k % 353 == 0, "Other").otherwise(F.col("gender")).alias("gender"),
        F.when(k % 311 == 0, "2").otherwise(F.col("SeniorCitizen").cast("string")).alias("SeniorCitizen"),
        "Partner",
        F.when(k % 3 == 0, "Yes").otherwise("No").alias("Dependents"),
        F.when(k % 401 == 0, "-1").when(k % 409 == 0, "many").otherwise(F.col("tenure").cast("string")).alias("tenure"),
        F.lit("Yes").alias("PhoneService"),
        F.when(k % 5 == 0, "No phone service").otherwise("No").alias("MultipleLines"),
        "InternetService",
        *[F.when(k % 7 != i, "No").alias(n) for i, n in enumerate(
            ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"))],
        F.when(k % 419 == 0, "Weekly").otherwise(F.col("Contract")).alias("Contract"),
        F.lit("No").alias("PaperlessBilling"),
        "PaymentMethod",
        F.when(k % 421 == 0, -1.0).otherwise(F.col("MonthlyCharges")).alias("MonthlyCharges"),
        "TotalCharges",
        F.when(k % 433 == 0, "Maybe").otherwise(F.col("Churn")).alias("Churn"),
    )


def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions before any decision: one per order, with the value of its customer."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prediction_id"),
        F.col("o_custkey").alias("c_custkey"),
        (((F.col("o_orderkey") * 7919) % 1000) / 1000.0).alias("prediction"),
        F.col("o_orderdate").alias("prediction_timestamp"),
        F.substring("o_orderpriority", 1, 1).alias("model_version"),
    )
    c = customers(spark, sf)
    worth = customer_value(c, SETTINGS.customer_value, "MonthlyCharges", "tenure")
    values = c.select("c_custkey", worth.alias("customer_value"))
    # Customers are unique on the right: adaptive execution splits a customer with many orders by itself.
    return o.join(values, "c_custkey", "left")


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log: scored orders with the single best action."""
    decided = decide_each(scored_orders(spark, sf), s=SETTINGS)
    return decided.withColumns(
        {
            "customerid": F.col("c_custkey").cast("string"),
            "churn_probability": F.col("prediction"),
            "request_id": F.concat(F.lit("req-"), F.date_format("prediction_timestamp", "yyyyMMdd")),
            "prediction_date": F.to_date("prediction_timestamp"),
        }
    ).drop("c_custkey")


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Label deliveries: many per prediction, some without a label."""
    churn = F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("prediction_id"), churn.cast("int").alias("churn"), F.col("l_shipdate").alias("label_available_at"), *TIE_BREAK
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return latest_labels(deliveries(spark, sf), "prediction_id", "churn", "label_available_at", TIE_BREAK)


def labeled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(prediction_id, churn_probability, churn) without actions, for metrics that need no more."""
    scores = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("prediction_id"),
        (((F.col("o_orderkey") * 7919) % 1000) / 1000.0).alias("churn_probability"),
        F.substring("o_orderpriority", 1, 1).alias("model_version"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )
    return labeled_predictions(scores, labels(spark, sf))


def labeled_log(spark: SparkSession, sf: str) -> DataFrame:
    return labeled_predictions(prediction_log(spark, sf), labels(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request events: path from the type, status 500 for errors and 404 for some clicks."""
    return table(spark, sf, "events").select(
        "ts",
        F.when(F.col("user_id") % 2 == 0, "get").otherwise("post").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500)
        .when((F.col("event_type") == "click") & (F.col("event_id") % 10 == 0), 404)
        .otherwise(200)
        .alias("status_code"),
        F.col("value").alias("latency_ms"),
    )


def training_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Training runs from purchases."""
    return table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.col("value").alias("estimated_training_cost"),
        (F.col("value") * 60).alias("training_duration_seconds"),
        F.when(F.col("event_id") % 3 != 0, "EUR").alias("cost_currency"),
    )


# --- the same tables in SQL --------------------------------------------------------------------------------

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "span": (
        (),
        """SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order, count(*) AS n_orders,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY o_custkey""",
    ),
    "customers": (
        ("span",),
        """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS "customerID",
        CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
        CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS "SeniorCitizen",
        CASE WHEN c_acctbal < 5000 THEN 'Yes' ELSE 'No' END AS "Partner",
        CASE c_nationkey % 3 WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' ELSE 'Two year' END AS "Contract",
        CASE WHEN n_regionkey < 2 THEN 'DSL' WHEN n_regionkey < 4 THEN 'Fiber optic' ELSE 'No' END AS "InternetService",
        c_mktsegment AS "PaymentMethod",
        coalesce(CAST(date_diff('day', CAST(first_order AS DATE), CAST(last_order AS DATE)) // 30 AS BIGINT), 0) AS tenure,
        coalesce(CAST(total AS DOUBLE) / n_orders / 10000, 0) AS "MonthlyCharges",
        CASE WHEN c_custkey % 97 = 0 THEN ' ' ELSE coalesce(CAST(total AS VARCHAR), '0.00') END AS "TotalCharges",
        CASE WHEN last_order < TIMESTAMP '2001-01-01' THEN 'Yes' ELSE 'No' END AS "Churn"
        FROM customer LEFT JOIN span ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "valued": (
        ("customers",),
        """SELECT c_custkey, greatest("MonthlyCharges" * CASE WHEN tenure < 12 THEN 12 ELSE 6 END, 25.0) AS customer_value FROM customers""",
    ),
    "scored": (
        ("valued",),
        """SELECT o_orderkey AS prediction_id, o_custkey, ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS prediction,
        o_orderdate AS prediction_timestamp, substr(o_orderpriority, 1, 1) AS model_version, customer_value
        FROM orders LEFT JOIN valued ON c_custkey = o_custkey""",
    ),
    "worth": (
        ("scored",),
        """SELECT *, prediction * (0.3::DOUBLE * customer_value) - 10 AS v_discount,
        prediction * (0.1::DOUBLE * customer_value) - 2 AS v_email FROM scored""",
    ),
    "log": (
        ("worth",),
        """SELECT prediction_id, CAST(o_custkey AS VARCHAR) AS customerid, prediction, prediction AS churn_probability, prediction_timestamp,
        model_version, customer_value, v_discount, v_email,
        CASE WHEN greatest(v_discount, v_email, 0) <= 0 THEN 'no_action' WHEN v_discount >= v_email THEN 'offer_discount' ELSE 'send_email' END AS action,
        greatest(v_discount, v_email, 0) AS expected_value,
        'req-' || strftime(prediction_timestamp, '%Y%m%d') AS request_id, CAST(prediction_timestamp AS DATE) AS prediction_date FROM worth""",
    ),
    "deliveries": (
        (),
        """SELECT l_orderkey AS prediction_id, CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS churn,
        l_shipdate AS label_available_at, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    ),
    "labels": (
        ("deliveries",),
        """SELECT prediction_id, churn, label_available_at FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id
        ORDER BY label_available_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, churn DESC) AS rn
        FROM deliveries WHERE churn IS NOT NULL) WHERE rn = 1""",
    ),
    "labeled": (("log", "labels"), "SELECT log.*, labels.churn FROM log JOIN labels USING (prediction_id)"),
    "pairs": (
        ("labels",),
        """SELECT o_orderkey AS prediction_id, ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS p, churn AS y,
        substr(o_orderpriority, 1, 1) AS model_version, strftime(o_orderdate, '%Y-%m') AS month FROM orders JOIN labels ON prediction_id = o_orderkey""",
    ),
    "requests": (
        (),
        """SELECT ts, CASE WHEN user_id % 2 = 0 THEN 'get' ELSE 'post' END AS method, '/' || event_type AS path,
        CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'click' AND event_id % 10 = 0 THEN 404 ELSE 200 END AS status_code,
        value AS latency_ms FROM events""",
    ),
    "runs": (
        (),
        """SELECT event_id AS run_id, ts AS start_time, value AS cost, value * 60 AS duration,
        CASE WHEN event_id % 3 <> 0 THEN 'EUR' END AS currency FROM events WHERE event_type = 'purchase'""",
    ),
    "contract_rows": (
        ("customers",),
        """SELECT c_custkey % 40 AS batch_id, CASE WHEN c_custkey % 331 <> 0 THEN "customerID" END AS "customerID",
        CASE WHEN c_custkey % 353 = 0 THEN 'Other' ELSE gender END AS gender,
        CASE WHEN c_custkey % 311 = 0 THEN '2' ELSE CAST("SeniorCitizen" AS VARCHAR) END AS "SeniorCitizen", "Partner",
        CASE WHEN c_custkey % 401 = 0 THEN '-1' WHEN c_custkey % 409 = 0 THEN 'many' ELSE CAST(tenure AS VARCHAR) END AS tenure,
        "InternetService", CASE WHEN c_custkey % 419 = 0 THEN 'Weekly' ELSE "Contract" END AS "Contract", "PaymentMethod",
        CASE WHEN c_custkey % 421 = 0 THEN -1.0 ELSE "MonthlyCharges" END AS "MonthlyCharges", "TotalCharges",
        CASE WHEN c_custkey % 433 = 0 THEN 'Maybe' ELSE "Churn" END AS "Churn" FROM customers""",
    ),
    "failed": (
        ("contract_rows",),
        """SELECT batch_id, "customerID", unnest([
        CASE WHEN "customerID" IS NULL THEN 'customerID:null' END,
        CASE WHEN gender NOT IN ('Female', 'Male') THEN 'gender:domain' END,
        CASE WHEN TRY_CAST("SeniorCitizen" AS DOUBLE) NOT IN (0, 1) THEN 'SeniorCitizen:domain' END,
        CASE WHEN TRY_CAST(tenure AS DOUBLE) IS NULL THEN 'tenure:type' END,
        CASE WHEN TRY_CAST(tenure AS DOUBLE) < 0 THEN 'tenure:minimum' END,
        CASE WHEN "Contract" NOT IN ('Month-to-month', 'One year', 'Two year') THEN 'Contract:domain' END,
        CASE WHEN "MonthlyCharges" < 0 THEN 'MonthlyCharges:minimum' END,
        CASE WHEN "Churn" NOT IN ('Yes', 'No') THEN 'Churn:domain' END]) AS rule FROM contract_rows""",
    ),
}


def _needed(name: str) -> list[str]:
    parents, _ = _CTES[name]
    return reduce(lambda acc, p: acc + _needed(p), parents, []) + [name]


def sql_over(names: str, body: str, extra: str = "") -> str:
    """``body`` with the named logical tables (space separated) and any further CTEs in front."""
    order = list(dict.fromkeys(n for name in names.split() for n in _needed(name)))
    parts = [f"{n} AS ({_CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}"
