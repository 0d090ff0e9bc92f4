"""Sources, sinks and jobs, each written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import jobs
from holdfast.config import DecisionSettings, FeatureSettings, ModelSettings
from holdfast.functions.scalars import number_column
from holdfast.operators import alignment, explain, learning, metrics, naming, validation
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded
from holdfast.session import work_dir
from holdfast.sources import snapshots, tables
from holdfast.streaming import monitoring

_ORDERS = "o_orderkey bigint, o_orderstatus string, o_totalprice double"


@query("csv_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_table(spark, sf):
    """A table written twice under a .csv name, so the second replaces the first, and read back by suffix with its types."""
    path = f"{work_dir(spark, 'tables')}/orders.csv"
    rows = B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tables.write_table(rows.limit(10), path)
    tables.write_table(rows, path)
    return tables.read_table(spark, path, schema=_ORDERS)


@query("parquet_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_table(spark, sf):
    path = f"{work_dir(spark, 'tables')}/orders.parquet"
    tables.write_table(B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return tables.read_table(spark, path)


def _batches(spark, sf, folder):
    """Customers in three files, written one after another."""
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    for i in range(3):
        rows.where(F.col("c_custkey") % 3 == i).coalesce(1).write.mode("append").option("header", True).csv(folder)
    return T.StructType.fromDDL("c_custkey bigint, c_mktsegment string")


@query("batch_files", "SELECT c_custkey % 3 AS batch, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, 1::BIGINT AS files FROM customer GROUP BY 1")
def batch_files(spark, sf):
    """All batch files of a folder, each row with its file."""
    folder = work_dir(spark, "batches")
    rows = tables.read_batches(spark, folder, _batches(spark, sf, folder))
    return rows.groupBy((F.col("c_custkey") % 3).alias("batch")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.countDistinct("batch_file").alias("files"))


@query("latest_batch", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 2")
def latest_batch(spark, sf):
    """Rows of the newest batch file."""
    folder = work_dir(spark, "batches")
    schema = _batches(spark, sf, folder)
    return tables.read_latest_batch(spark, folder, "unused", schema)


_INFERENCE = sql_over(
    "contract_rows failed",
    """SELECT rule, count(*) AS rows_failed FROM failed WHERE rule IS NOT NULL AND rule NOT LIKE 'Churn:%' GROUP BY rule""",
)


@query("request_validation", _INFERENCE)
def request_validation(spark, sf):
    """Requests as JSON lines, read with their types, and checked against the contract without its target."""
    folder = work_dir(spark, "requests")
    rows = B.contract_rows(spark, sf).drop("batch_id", "Churn")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    text.write.json(folder)
    requests = tables.read_requests(spark, folder, text.schema)
    contract = validation.inference_contract()
    validation.require_columns(requests, [r.name for r in contract if r.required])
    return validation.validation_report(validation.apply_contract(requests, contract))


@query("request_names", "SELECT c_custkey AS customer_key, c_name AS customer_name, upper(c_mktsegment) AS market_segment, c_acctbal AS balance FROM customer")
def request_names(spark, sf):
    """Columns of a request under the names that the model knows; those of a drift check are only put in lower case."""
    c = B.table(spark, sf, "customer")
    sent = c.select(F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("Customer Name"), F.upper("c_mktsegment").alias("Market Segment"), F.col("c_acctbal").alias("Balance"))
    return naming.lower_names(naming.request_names(sent))


@query("replayed_schema", """SELECT c_custkey, c_acctbal, 0::BIGINT AS visits FROM customer""")
def replayed_schema(spark, sf):
    """A feature schema, captured as JSON and replayed on a table with other columns, another order and text for numbers."""
    c = B.table(spark, sf, "customer")
    text = alignment.capture_schema(c.select("c_custkey", "c_acctbal", F.lit(1).cast("bigint").alias("visits")))
    sent = c.select("c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), F.col("c_custkey").cast("string").alias("c_custkey"))
    return alignment.align(sent, alignment.load_schema(text))


@query("logged_stream", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS prediction_date, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def logged_stream(spark, sf):
    """A stream of predictions in the date-partitioned log, by day."""
    folder = work_dir(spark, "logged")
    source = spark.readStream.schema(B.SCHEMAS["orders"]).option("pathGlobFilter", "orders.parquet").parquet(sf)
    predictions = source.select(F.col("o_orderkey").alias("prediction_id"), F.col("o_orderdate").cast("timestamp").alias("prediction_timestamp"))
    # A partition per month keeps the number of files of this small stream low.
    monitoring.log_stream(predictions, f"{folder}/log", f"{folder}/state", by_month=True).awaitTermination()
    log = spark.read.parquet(f"{folder}/log")
    return log.groupBy(F.date_format("prediction_timestamp", "yyyy-MM-dd").alias("prediction_date")).agg(F.count("*").alias("n"), F.sum("prediction_id").alias("keys"))


_EXPORT = """SELECT customer_id, churn_probability, customer_value, action, expected_value FROM (SELECT prediction_id AS customer_id, churn_probability, round(customer_value, 6) AS customer_value, action,
round(expected_value, 6) AS expected_value FROM log WHERE expected_value >= 1)"""


@query("exported_list", sql_over("log", _EXPORT))
def exported_list(spark, sf):
    """The prioritized list as its CSV export has it: fixed columns under a dated name."""
    rows = B.prediction_log(spark, sf).where("expected_value >= 1").withColumnRenamed("prediction_id", "customer_id")
    path = tables.export_prioritized(rows, work_dir(spark, "export"), F.lit("2024-05-06").cast("date"))
    schema = "customer_id bigint, churn_probability double, customer_value double, action string, expected_value double"
    return rounded(tables.read_table(spark, path, schema=schema))


@query("archived_batch", "SELECT o_orderstatus, count(*) AS n, '20240506_070809' AS run_ts FROM orders GROUP BY 1")
def archived_batch(spark, sf):
    folder = work_dir(spark, "archive")
    tables.archive(B.table(spark, sf, "orders"), folder, "20240506_070809")
    return spark.read.parquet(folder).groupBy("o_orderstatus", "run_ts").agg(F.count("*").alias("n"))


@query(
    "dataset_versions",
    """SELECT version, name, n, reused FROM (SELECT 'ds_20240101_000000' AS version, 'train' AS name, count(*) AS n, false AS reused FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT 'ds_20240101_000000', 'val', count(*), false FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'ds_20240102_000000', 'train', count(*), true FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT 'ds_20240102_000000', 'val', count(*), false FROM customer WHERE c_custkey % 10 = 0)""",
)
def dataset_versions(spark, sf):
    """Two snapshots; between them one of two tables changes, and the other is referenced, not copied."""
    folder = work_dir(spark, "versions")
    c = B.table(spark, sf, "customer")
    c.where("c_custkey % 5 <> 0").write.parquet(f"{folder}/train.parquet")
    sources = {"train": f"{folder}/train.parquet", "val": f"{folder}/val.parquet"}
    out = None
    for day, step in ((1, 5), (2, 10)):
        c.where(F.col("c_custkey") % step == 0).write.mode("overwrite").parquet(sources["val"])
        made = snapshots.snapshot(spark, f"{folder}/versions", sources, f"ds_2024010{day}_000000", config={"step": step})
        for name, path in made["snapshots"].items():
            version = made["dataset_version"]
            rows = spark.read.parquet(path).agg(F.lit(version).alias("version"), F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(version not in path).alias("reused"))
            out = rows if out is None else out.unionAll(rows)
    return out


@query(
    "feature_table",
    sql_over(
        "customers",
        """SELECT tenure, round("MonthlyCharges", 6) AS monthlycharges, gender = 'Male' AS gender_Male, "Contract" = 'One year' AS "contract_One year", "Contract" = 'Two year' AS "contract_Two year", "Churn" AS churn FROM customers""",
    ),
)
def feature_table(spark, sf):
    """The stored feature table, encoded with the vocabulary that the job stored beside it."""
    folder = work_dir(spark, "features")
    raw = B.customers(spark, sf).select("customerID", "tenure", "MonthlyCharges", "gender", "Contract", "Churn")
    jobs.feature_job(spark, raw, folder, FeatureSettings(categorical_columns=("gender", "contract")))
    assert jobs.read_vocabulary(spark, folder).output_columns() == ["gender_Male", "contract_One year", "contract_Two year"]
    return rounded(spark.read.parquet(f"{folder}/features"))


@query(
    "evaluated_batch",
    sql_over(
        "labeled",
        """SELECT count(*) AS n_samples, CAST(sum(h * y) AS BIGINT) AS true_positives, round(2.0::DOUBLE * sum(h * y) / (sum(h) + sum(y)), 6) AS f1_score, round(avg((p - y) * (p - y)), 6) AS brier_score,
        round(sum(y * saved - cost), 4) AS business_realized_profit FROM (SELECT churn_probability AS p, churn AS y, CASE WHEN churn_probability >= 0.5 THEN 1 ELSE 0 END AS h,
        customer_value * CASE action WHEN 'send_email' THEN 0.1::DOUBLE WHEN 'offer_discount' THEN 0.3::DOUBLE ELSE 0 END AS saved, CASE action WHEN 'send_email' THEN 2 WHEN 'offer_discount' THEN 10 ELSE 0 END AS cost FROM labeled)""",
    ),
)
def evaluated_batch(spark, sf):
    """A labeled batch file, evaluated with its business fields and appended to a history."""
    folder = work_dir(spark, "evaluation")
    batch = B.labeled_log(spark, sf).withColumn("Churn", F.when(F.col("churn") == 1, "Yes").otherwise("No")).select("Churn", "churn_probability", "action", "customer_value")
    batch.write.parquet(f"{folder}/batch.parquet")
    row = jobs.evaluate_batch(spark, f"{folder}/batch.parquet", f"{folder}/history")
    return rounded(row.select("n_samples", "true_positives", "f1_score", "brier_score", "business_realized_profit"), business_realized_profit=4)


@query(
    "own_metrics",
    sql_over(
        "pairs",
        """SELECT model_version, count(*) AS n_samples, round(sum(p * y) / sum(y) - sum(p * (1 - y)) / sum(1 - y), 6) AS score_gap, CAST(NULL AS DOUBLE) AS impossible FROM pairs GROUP BY model_version""",
    ),
)
def own_metrics(spark, sf):
    """Metrics of the caller in the common report: one from the score table, and one that cannot be built."""

    def gap():
        p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
        return F.try_divide(F.sum(p * pos), F.sum(pos)) - F.try_divide(F.sum(p * neg), F.sum(neg))

    def impossible():
        raise ValueError("needs three classes")

    rows = metrics.classification_metrics(B.labeled_scores(spark, sf), "churn", "churn_probability", 0.5, ["model_version"], True, {"score_gap": gap, "impossible": impossible})
    return rounded(rows.select("model_version", "n_samples", "score_gap", "impossible"))


# --- models ------------------------------------------------------------------------------------------------

_FLAGS = {
    "male": 'gender = \'Male\'', "senior": '"SeniorCitizen" = 1', "partner": '"Partner" = \'Yes\'', "one_year": '"Contract" = \'One year\'', "fiber": '"InternetService" = \'Fiber optic\'',
    "building": '"PaymentMethod" = \'BUILDING\'', "long": "tenure >= 60", "costly": '"MonthlyCharges" >= 25',
}


def _flagged(spark, sf):
    """Customers as yes/no features and their churn."""
    c = B.customers(spark, sf)
    return c.select("customerID", (F.col("Churn") == "Yes").cast("int").alias("y"), *[F.expr(e.replace('"', "`")).cast("int").alias(n) for n, e in _FLAGS.items()])


_FLAG_ROWS = "flagged AS (SELECT \"customerID\" AS id, CASE WHEN \"Churn\" = 'Yes' THEN 1 ELSE 0 END AS y, [" + ", ".join(f"({e})::INTEGER" for e in _FLAGS.values()) + "] AS x FROM customers)"
_RATE = 0.1
_ROUNDS = 8


def _boosted(rounds: int) -> str:
    """CTEs of gradient boosting with one-level trees on yes/no features: per round the split with the least squared error on the residuals of the log loss, and its means as steps.
    The first tree is fitted on the labels as -1 and 1 and counts in full."""
    ctes = [_FLAG_ROWS, "m0 AS MATERIALIZED (SELECT id, x, 2.0::DOUBLE * y - 1 AS s, 0.0::DOUBLE AS f FROM flagged)"]
    for r in range(1, rounds + 1):
        target = "s" if r == 1 else "4 * s / (1 + exp(2 * s * f))"
        weight = "1.0::DOUBLE" if r == 1 else f"{_RATE}::DOUBLE"
        ctes += [
            f"t{r} AS MATERIALIZED (SELECT *, {target} AS g FROM m{r - 1})",
            f"c{r} AS (SELECT i, avg(g) FILTER (x[i] = 0) AS low, avg(g) FILTER (x[i] = 1) AS high, count(*) FILTER (x[i] = 0) AS n0, count(*) FILTER (x[i] = 1) AS n1 FROM t{r}, (SELECT unnest(range(1, {len(_FLAGS) + 1})) AS i) GROUP BY i)",
            f"b{r} AS MATERIALIZED (SELECT i, low, high FROM c{r} WHERE n0 > 0 AND n1 > 0 ORDER BY n0 * low * low + n1 * high * high DESC, i LIMIT 1)",
            f"m{r} AS MATERIALIZED (SELECT id, x, s, f + {weight} * CASE WHEN x[i] = 1 THEN high ELSE low END AS f FROM t{r}, b{r})",
        ]
    return ", ".join(ctes)


@query("boosted_stumps", sql_over("customers", f'SELECT id AS "customerID", round(1 / (1 + exp(-2 * f)), 6) AS churn_probability FROM m{_ROUNDS}', _boosted(_ROUNDS)))
def boosted_stumps(spark, sf):
    """Spark's gradient boosting with trees of one level, against the same rounds in SQL."""
    rows = _flagged(spark, sf)
    model = learning.fit(rows, list(_FLAGS), "y", ModelSettings(n_estimators=_ROUNDS, max_depth=1, learning_rate=_RATE))
    return rounded(learning.score(model, rows, list(_FLAGS)).select("customerID", "churn_probability"))


_BEST = """c AS (SELECT i, avg(y) FILTER (x[i] = 0) AS low, avg(y) FILTER (x[i] = 1) AS high, count(*) FILTER (x[i] = 0) AS n0, count(*) FILTER (x[i] = 1) AS n1
FROM flagged, (SELECT unnest(range(1, {n} + 1)) AS i) GROUP BY i), b AS (SELECT i, low, high FROM c WHERE n0 > 0 AND n1 > 0 ORDER BY n0 * low * (1 - low) + n1 * high * (1 - high), i LIMIT 1)""".replace("{n}", str(len(_FLAGS)))
_FLAG_NAMES = "[" + ", ".join(f"'{n}'" for n in _FLAGS) + "]"


@query("tree_importance", sql_over("customers", f"SELECT {_FLAG_NAMES}[k] AS feature, CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0 END AS importance FROM b, (SELECT unnest(range(1, {len(_FLAGS) + 1})) AS k)", f"{_FLAG_ROWS}, {_BEST}"))
def tree_importance(spark, sf):
    """Importances of a tree of one level: all of it lies with the feature of its only cut."""
    model = learning.fit(_flagged(spark, sf), list(_FLAGS), "y", ModelSettings(kind="decision_tree", max_depth=1))
    return explain.importance_table(model.stages[-1].featureImportances.toArray(), list(_FLAGS), spark)


@query("forest_scores", sql_over("customers", f'SELECT id AS "customerID", round(CASE WHEN x[i] = 1 THEN high ELSE low END, 6) AS churn_probability FROM flagged, b', f"{_FLAG_ROWS}, {_BEST}"))
def forest_scores(spark, sf):
    """A random forest that samples neither rows nor features is its only tree."""
    whole = {"featureSubsetStrategy": "all", "bootstrap": False}
    rows = _flagged(spark, sf)
    model = learning.fit(rows, list(_FLAGS), "y", ModelSettings(kind="random_forest", n_estimators=1, max_depth=1, extra=whole))
    return rounded(learning.score(model, rows, list(_FLAGS)).select("customerID", "churn_probability"))


@query("voted_scores", sql_over("customers", f'SELECT id AS "customerID", round((1 / (1 + exp(-2 * f)) + CASE WHEN x[i] = 1 THEN high ELSE low END) / 2, 6) AS churn_probability FROM m{_ROUNDS}, b', f"{_boosted(_ROUNDS)}, {_BEST}"))
def voted_scores(spark, sf):
    """Mean probability of boosting and a tree."""
    rows = _flagged(spark, sf)
    settings = (ModelSettings(n_estimators=_ROUNDS, max_depth=1, learning_rate=_RATE), ModelSettings(kind="decision_tree", max_depth=1))
    models = [learning.fit(rows, list(_FLAGS), "y", s) for s in settings]
    return rounded(learning.soft_vote(rows, models, list(_FLAGS)).select("customerID", "churn_probability"))


_SCORED = """SELECT customerid, round(p, 6) AS churn_probability, CASE WHEN p * 0.1::DOUBLE * v - 2 >= 0 THEN 'send_email' ELSE 'no_action' END AS action, round(greatest(p * 0.1::DOUBLE * v - 2, 0), 6) AS expected_value, 'req-1' AS request_id
FROM (SELECT "customerID" AS customerid, least(tenure / 80.0::DOUBLE, 1.0) AS p, greatest("MonthlyCharges" * CASE WHEN tenure < 12 THEN 12 ELSE 6 END, 25.0) AS v FROM customers)"""


@query("scored_batch", sql_over("customers", _SCORED))
def scored_batch(spark, sf):
    """The batch scoring job: raw customers to logged decisions, read back by request. The scorer is a formula; no discounts are given."""
    folder = work_dir(spark, "scoring")
    raw = B.customers(spark, sf).select("customerID", "tenure", "MonthlyCharges", "gender", "Contract")
    settings = FeatureSettings(numeric_columns=("tenure", "monthlycharges"), categorical_columns=("gender", "contract"))
    _, vocabulary = jobs.feature_job(spark, raw, folder, settings)
    settings_ = DecisionSettings(max_discount_budget=None, max_discount_rate=None)

    def scorer(encoded):
        return encoded.withColumn("churn_probability", F.least(number_column(encoded, "tenure") / 80.0, F.lit(1.0)))

    rows = jobs.scoring_job(spark, raw, vocabulary, scorer, f"{folder}/log", "req-1", settings, settings_)
    return rounded(rows.select("customerid", "churn_probability", "action", "expected_value", "request_id"))
