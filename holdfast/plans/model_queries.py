"""Model jobs and streams. Streams run to the end of the available data and the result is read back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from holdfast import jobs
from holdfast.config import FeatureSettings, ModelSettings
from holdfast.functions.scalars import to_number_or_zero
from holdfast.operators import learning, validation
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded
from holdfast.session import work_dir
from holdfast.streaming import inbox, labels, monitoring, requests

FEATURES = ["tenure", "MonthlyCharges", "total", "SeniorCitizen"]


def _matrix(spark, sf):
    c = B.customers(spark, sf)
    return c.select(
        "customerID", "tenure", "MonthlyCharges", "SeniorCitizen", "Churn",
        to_number_or_zero(F.col("TotalCharges")).alias("total"), (F.col("Churn") == "Yes").cast("int").alias("y"),
    )


def _parts(spark, sf):
    """Training and validation parts, written once as the hand-over between the split and the model job."""
    return jobs.split_job(spark, _matrix(spark, sf), work_dir(spark, "splits"), "customerID", "Churn")


@query("gbt_scores")
def gbt_scores(spark, sf):
    """Fit boosting on the training part and score everyone."""
    train, _ = _parts(spark, sf)
    model = learning.fit(train, FEATURES, "y", ModelSettings(n_estimators=5, max_depth=3, learning_rate=0.1))
    return learning.score(model, _matrix(spark, sf), FEATURES).select("customerID", "churn_probability")


@query("soft_vote")
def soft_vote(spark, sf):
    """Mean probability of a tree and a logistic model."""
    train, validation_rows = _parts(spark, sf)
    kinds = ("decision_tree", "logistic_regression")
    models = [learning.fit(train, FEATURES, "y", ModelSettings(kind=k)) for k in kinds]
    return learning.soft_vote(validation_rows, models, FEATURES).select("customerID", "y", "churn_probability")


@query("train_run")
def train_run(spark, sf):
    """The whole training job: fit, tune the threshold, validate, and keep the run row."""
    train, validation_rows = _parts(spark, sf)
    _, run = learning.train(train, validation_rows, FEATURES, "y", ModelSettings(kind="logistic_regression"))
    return run


# --- a logistic model on the encoded matrix, fitted a second time in SQL -----------------------------------

NUMBERS = ("tenure", "monthlycharges")
CATEGORIES = ("gender", "seniorcitizen", "partner", "contract", "internetservice", "paymentmethod")


def _customer_features(spark, sf, folder):
    """The stored feature table of all customers, with their id, and its vocabulary."""
    names = ["customerID", "tenure", "MonthlyCharges", "gender", "SeniorCitizen", "Partner", "Contract", "InternetService", "PaymentMethod", "Churn"]
    settings = FeatureSettings(numeric_columns=NUMBERS, categorical_columns=CATEGORIES, drop_columns=("customerid",))
    return jobs.feature_job(spark, B.customers(spark, sf).select(*names), folder, settings, keep_id="customerid")


#: Encoded columns as the vocabulary names and orders them: (column, source, SQL). Levels that the small tables have, the first of each column left out.
_COLUMNS = [
    ("tenure", "tenure", "tenure"), ("monthlycharges", "monthlycharges", '"MonthlyCharges"'), ("gender_Male", "gender", "gender = 'Male'"),
    ("seniorcitizen_1", "seniorcitizen", '"SeniorCitizen" = 1'), ("partner_Yes", "partner", "\"Partner\" = 'Yes'"),
    *[(f"contract_{v}", "contract", f"\"Contract\" = '{v}'") for v in ("One year", "Two year")],
    *[(f"internetservice_{v}", "internetservice", f"\"InternetService\" = '{v}'") for v in ("Fiber optic", "No")],
    *[(f"paymentmethod_{v}", "paymentmethod", f"\"PaymentMethod\" = '{v}'") for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")],
]


def _newton(n: int, steps: int = 12) -> str:
    """CTEs that fit ``y`` on ``v`` (1 and the features): Newton steps, each with the sums of gradient and curvature over all rows, solved by elimination."""
    row = [", ".join(f"sum(w * v[{i}] * v[{j}])" for j in range(1, n + 1)) + f", sum((y - p) * v[{i}])" for i in range(1, n + 1)]
    solved = "SELECT any_value(step) AS step, any_value(b) AS b, [" + ", ".join(f"[{r}]" for r in row) + "] AS m FROM sums"
    for k in range(1, n + 1):
        solved = f"SELECT step, b, [[CASE WHEN i = {k} THEN m[{k}][j] / m[{k}][{k}] ELSE m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] END for j in range(1, {n + 2})] for i in range(1, {n + 1})] AS m FROM ({solved})"
    return f"""newton AS (SELECT 0 AS step, [0.0::DOUBLE for i in range(0, {n})] AS b UNION ALL
    SELECT step + 1, [b[i] + m[i][{n + 1}] for i in range(1, {n + 1})] FROM (WITH sums AS (SELECT step, b, v, y, p, p * (1 - p) AS w FROM (
    SELECT step, b, v, y, 1 / (1 + exp(-list_inner_product(b, v))) AS p FROM newton, x WHERE step < {steps})) {solved} WHERE step IS NOT NULL)),
    fitted AS (SELECT b FROM newton WHERE step = {steps})"""


_X = "x AS (SELECT \"customerID\" AS id, CASE WHEN \"Churn\" = 'Yes' THEN 1 ELSE 0 END AS y, [1, " + ", ".join(f"({e})::INTEGER::DOUBLE" if "=" in e else f"({e})::DOUBLE" for _, _, e in _COLUMNS) + "]::DOUBLE[] AS v FROM customers)"
_FITTED = f"{_X}, {_newton(len(_COLUMNS) + 1)}"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_SOURCES = list(dict.fromkeys(source for _, source, _ in _COLUMNS))
_IMPACTS = ", ".join(
    "{'feature': '" + s + "', 'impact': " + " + ".join(f"b[{i}] * (v[{i}] - means[{i}])" for i, (_, source, _) in enumerate(_COLUMNS, 2) if source == s) + "}" for s in _SOURCES
)


@query(
    "explain_fitted",
    _recursive(
        sql_over(
            "customers",
            """SELECT id AS customerid, rank, feature, round(impact, 6) AS impact, CASE WHEN impact > 0 THEN 'increases_churn' ELSE 'reduces_churn' END AS direction, round_even(size / total * 100, 2) AS impact_pct
            FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, feature)::INTEGER AS rank, sum(size) OVER (PARTITION BY id) AS total
            FROM (SELECT id, e.feature, e.impact, abs(e.impact) AS size FROM impacts) WHERE size > 1e-6) WHERE rank <= 5""",
            f"{_FITTED}, middle AS (SELECT [{', '.join(f'avg(v[{i}])' for i in range(1, len(_COLUMNS) + 2))}] AS means FROM x), impacts AS (SELECT id, unnest([{_IMPACTS}]) AS e FROM x, fitted, middle)",
        )
    ),
)
def explain_fitted(spark, sf):
    """From raw customers to reasons: encode, fit a logistic model, store it, and explain every customer from the stored coefficients."""
    folder = work_dir(spark, "explain")
    features, _ = _customer_features(spark, sf, folder)
    columns = [c for c in features.columns if c not in ("customerid", "churn")]
    model, run = jobs.training_job(features, features, folder, columns, s=ModelSettings(kind="logistic_irls"))
    reasons = jobs.explain_job(spark, folder, run.first().run_id, features, "customerid")
    return reasons.withColumn("impact", F.round(F.col("impact") * 1e6, 0) / 1e6)


@query(
    "logistic_scores",
    _recursive(sql_over("customers", "SELECT id AS customerid, y, round(1 / (1 + exp(-list_inner_product(b, v))), 6) AS churn_probability FROM x, fitted", _FITTED)),
)
def logistic_scores(spark, sf):
    """Probabilities of a logistic model of the encoded matrix, read back from where the training job stored it."""
    folder = work_dir(spark, "logistic")
    features, _ = _customer_features(spark, sf, folder)
    columns = [c for c in features.columns if c not in ("customerid", "churn")]
    _, run = jobs.training_job(features, features, folder, columns, s=ModelSettings(kind="logistic_irls"))
    model = PipelineModel.load(f"{folder}/models/{run.first().run_id}")
    scored = learning.score(model, features, columns)
    return rounded(scored.select("customerid", (F.col("churn") == "Yes").cast("int").alias("y"), "churn_probability"))


def _stream(spark, sf, name):
    return spark.readStream.schema(B.SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "stream_labels",
    """SELECT o_orderkey AS prediction_id, o_orderkey % 2 AS churn, 25 + o_orderkey % 41 AS waited,
    CASE WHEN 25 + o_orderkey % 41 BETWEEN 30 AND 60 THEN 'stream' ELSE 'reconciled' END AS found_by FROM orders""",
)
def stream_labels(spark, sf):
    """Predictions joined with labels that arrive 25 to 65 days later: 30 to 60 days match in the stream, the rest is reconciled."""

    def both(orders):
        predicted_at = F.col("o_orderdate").cast("timestamp")
        waited = (F.lit(25) + F.col("o_orderkey") % 41).cast("int")
        key = F.col("o_orderkey").alias("prediction_id")
        delivered = orders.select(key, (F.col("o_orderkey") % 2).alias("churn"), (predicted_at + F.make_interval(days=waited)).alias("labeled_at"))
        return orders.select(key, predicted_at.alias("predicted_at")), delivered

    out = work_dir(spark, "stream-labels")
    matched = labels.match_labels(*both(_stream(spark, sf, "orders")))
    stream = matched.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    rest = labels.reconcile_labels(*both(B.table(spark, sf, "orders")), rows)
    found = rows.withColumn("found_by", F.lit("stream")).unionByName(rest.withColumn("found_by", F.lit("reconciled")))
    return found.select("prediction_id", "churn", F.datediff("labeled_at", "predicted_at").cast("bigint").alias("waited"), "found_by")


@query(
    "stream_inbox",
    sql_over(
        "contract_rows failed",
        """SELECT batch_id, verdict, count(*) AS n FROM (SELECT CAST(c.batch_id AS INTEGER) AS batch_id, CASE WHEN b.batch_id IS NULL THEN 'accepted' ELSE 'quarantined' END AS verdict
        FROM contract_rows c LEFT JOIN (SELECT DISTINCT batch_id FROM failed WHERE rule IS NOT NULL) b USING (batch_id)) GROUP BY batch_id, verdict""",
    ),
)
def stream_inbox(spark, sf):
    """Batches arrive as files and are accepted or quarantined whole."""
    out = work_dir(spark, "stream-inbox")
    rows = B.contract_rows(spark, sf)
    text = rows.select("batch_id", *[F.col(c).cast("string") for c in rows.columns if c != "batch_id"])
    text.repartition("batch_id").write.partitionBy("batch_id").option("header", True).csv(f"{out}/inbox")
    schema = text.schema
    stream = inbox.read_inbox(spark, f"{out}/inbox", schema).withColumn("batch_id", F.col("batch_id").cast("int"))
    run = inbox.ingest_inbox(stream, f"{out}/batches", f"{out}/state", validation.CUSTOMER_CONTRACT, "batch_id")
    run.awaitTermination()
    good = validation.stored_batches(spark, f"{out}/batches", True).select("batch_id", F.lit("accepted").alias("verdict"))
    bad = validation.stored_batches(spark, f"{out}/batches", False).select("batch_id", F.lit("quarantined").alias("verdict"))
    return good.unionByName(bad).groupBy("batch_id", "verdict").agg(F.count("*").alias("n"))


@query(
    "stream_latest_labels",
    sql_over("labels", "SELECT prediction_id, churn FROM labels"),
)
def stream_latest_labels(spark, sf):
    """Labels in three deliveries, corrections before and after what they correct: each delivery is merged into the keyed table, the last label wins."""
    out = work_dir(spark, "stream-latest")
    churn = F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    delivered = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("prediction_id"), churn.cast("int").alias("churn"), F.col("l_shipdate").alias("label_available_at"), *B.TIE_BREAK
    )
    for third in range(3):
        delivered.where(F.col("l_partkey") % 3 == third).write.parquet(f"{out}/in/delivery={third}")
        source = spark.readStream.schema(delivered.schema).parquet(f"{out}/in/*")
        labels.keep_latest(source, f"{out}/table", f"{out}/state", tie_break=B.TIE_BREAK, buckets=8).awaitTermination()
    return labels.read_latest(spark, f"{out}/table", delivered.schema, tie_break=B.TIE_BREAK, buckets=8).select("prediction_id", "churn")


_RELEASES = ("1996-06-30", "1998-06-30", "2000-06-30")


@query(
    "delayed_release",
    """WITH pending AS (SELECT o_orderkey, o_orderkey % 2 AS churn, o_orderdate::DATE + 30 AS due, o_orderkey % 3 = 0 AS late FROM orders)
    SELECT until, count(*) AS n, CAST(sum(churn) AS BIGINT) AS churned, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT *, CASE WHEN due <= DATE '1996-06-30' AND NOT late THEN '1996-06-30'
    WHEN due <= DATE '1998-06-30' THEN '1998-06-30' WHEN due <= DATE '2000-06-30' THEN '2000-06-30' END AS until FROM pending) WHERE until IS NOT NULL GROUP BY until""",
)
def delayed_release(spark, sf):
    """Labels wait until they are due; some are delivered after the first release has passed their day, and come with the next."""
    out = work_dir(spark, "release")
    orders = B.table(spark, sf, "orders")
    pending = orders.select(F.col("o_orderkey").alias("prediction_id"), (F.col("o_orderkey") % 2).alias("churn"), F.date_add(F.col("o_orderdate"), 30).alias("due"))
    late = F.col("prediction_id") % 3 == 0
    for i, (part, until) in enumerate(zip((~late, late, None), _RELEASES)):
        if part is not None:
            pending.where(part).write.parquet(f"{out}/in/delivery={i}")
            source = spark.readStream.schema(pending.schema).parquet(f"{out}/in/*")
            labels.enqueue_labels(source, "due", f"{out}/waiting", f"{out}/released", f"{out}/state").awaitTermination()
        labels.release_due(spark, f"{out}/waiting", f"{out}/released", until)
    released = labels.read_released(spark, f"{out}/released").withColumn("until", F.col("until").cast("string"))
    return released.groupBy("until").agg(F.count("*").alias("n"), F.sum("churn").alias("churned"), F.sum("prediction_id").alias("keys"))


_DAYS = ("1996-12-31", "1999-12-31", "2003-12-31")


@query(
    "monitoring_days",
    sql_over(
        "labeled labels",
        """SELECT until, n_samples, round(f1_score, 6) AS f1_score, round(recall, 6) AS recall, round(roc_auc, 6) AS roc_auc, round(brier_score, 6) AS brier_score, round(expected_profit, 4) AS expected_profit,
        round(business_realized_profit, 4) AS business_realized_profit, CASE WHEN n_samples < 20 THEN false ELSE f1_score < 0.6 OR recall < 0.65 OR coalesce(roc_auc < 0.75, false) OR brier_score > 0.22 END AS retrain_triggered,
        until = '1999-12-31' AND CASE WHEN n_samples < 20 THEN false ELSE f1_score < 0.6 OR recall < 0.65 OR coalesce(roc_auc < 0.75, false) OR brier_score > 0.22 END AS champion_promoted FROM (
        SELECT until, count(*) AS n_samples, CASE WHEN sum(h) + sum(y) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(h * y) / (sum(h) + sum(y)) END AS f1_score,
        CASE WHEN sum(y) = 0 THEN 0 ELSE sum(h * y)::DOUBLE / sum(y) END AS recall,
        CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS roc_auc,
        avg((p - y) * (p - y)) AS brier_score, sum(expected_value) AS expected_profit,
        sum(y * customer_value * CASE action WHEN 'send_email' THEN 0.1::DOUBLE WHEN 'offer_discount' THEN 0.3::DOUBLE ELSE 0 END - CASE action WHEN 'send_email' THEN 2 WHEN 'offer_discount' THEN 10 ELSE 0 END) AS business_realized_profit
        FROM (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS h, rank() OVER (PARTITION BY until ORDER BY p) + (count(*) OVER (PARTITION BY until, p) - 1) / 2.0 AS mid
        FROM (SELECT until, churn_probability AS p, labeled.churn AS y, expected_value, customer_value, action FROM labeled JOIN labels USING (prediction_id)
        JOIN (SELECT unnest(['1996-12-31', '1999-12-31', '2003-12-31']) AS until) ON label_available_at::DATE <= until::DATE)) GROUP BY until)""",
    ),
)
def monitoring_days(spark, sf):
    """Three monitoring cycles: labels are released, measured from merged states and judged; the retraining of the second is promoted."""
    folder = work_dir(spark, "monitoring")
    delivered = B.labels(spark, sf).select("prediction_id", "churn", F.to_date("label_available_at").alias("due"))
    delivered.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(delivered.schema).parquet(f"{folder}/in")
    labels.enqueue_labels(source, "due", f"{folder}/waiting", f"{folder}/released", f"{folder}/enqueued").awaitTermination()
    B.prediction_log(spark, sf).write.parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    for day in _DAYS:
        monitoring.monitoring_day(spark, log, folder, day, retrain=lambda day=day: day == _DAYS[1])
    kept = ("n_samples", "f1_score", "recall", "roc_auc", "brier_score", "expected_profit", "business_realized_profit", "retrain_triggered", "champion_promoted")
    rows = monitoring.read_days(spark, folder).select(F.col("until").cast("string").alias("until"), *kept)
    return rounded(rows, expected_profit=4, business_realized_profit=4)


def _as_text(column: str):
    entries = F.transform(F.map_entries(column), lambda e: F.concat(e.key, F.lit(":"), e.value))
    return F.array_join(F.array_sort(entries), ",").alias(column)


@query(
    "stream_summary",
    sql_over(
        "requests",
        """SELECT w AS window_start, count(*) AS requests_total, count(*) FILTER (status_code < 300) AS success_total, count(*) FILTER (status_code >= 300) AS error_total,
        round_even(count(*) FILTER (status_code < 300)::DOUBLE / count(*), 4) AS success_rate, round_even(count(*) FILTER (status_code >= 300)::DOUBLE / count(*), 4) AS error_rate,
        max(v / 100.0::DOUBLE) FILTER (i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50, max(v / 100.0::DOUBLE) FILTER (i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS p95,
        max(v / 100.0::DOUBLE) FILTER (i = CAST(round_even((n - 1) * 0.99, 0) AS BIGINT)) AS p99, round_even(sum(v)::DOUBLE / count(*) / 100, 2) AS avg_ms, max(v) / 100.0::DOUBLE AS max_ms,
        (SELECT string_agg(status_code || ':' || n, ',' ORDER BY status_code || ':' || n) FROM (SELECT status_code, count(*) AS n FROM win AS b WHERE b.w = a.w GROUP BY status_code)) AS requests_by_status,
        (SELECT string_agg(path || ':' || n, ',' ORDER BY path || ':' || n) FROM (SELECT path, count(*) AS n FROM win AS b WHERE b.w = a.w GROUP BY path)) AS requests_by_path
        FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY w) AS n FROM win) AS a
        WHERE w + 900 <= (SELECT max(epoch_ms(ts)) FROM requests) / 1000.0::DOUBLE - 600 GROUP BY w""",
        """win AS (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - 300 * s AS w, status_code, path, CAST(round_even(latency_ms * 100, 0) AS BIGINT) AS v
        FROM requests, (SELECT unnest([0, 1, 2]) AS s))""",
    ),
)
def stream_summary(spark, sf):
    """Summary of every sliding window that the watermark has closed, from a stream; exact, and with counts by status and path."""
    events = _stream(spark, sf, "events")
    shaped = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500)
        .when((F.col("event_type") == "click") & (F.col("event_id") % 10 == 0), 404)
        .otherwise(200)
        .alias("status_code"),
        F.col("value").alias("latency_ms"),
    )
    out = work_dir(spark, "stream-summary")
    stream = requests.live_summary(shaped).writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    plain = [c for c in rows.columns if c not in ("window_start", "requests_by_status", "requests_by_path")]
    return rows.select(F.unix_timestamp("window_start").alias("window_start"), *plain, _as_text("requests_by_status"), _as_text("requests_by_path"))


@query(
    "stream_counters",
    sql_over(
        "requests",
        """SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, method, path, status_code, count(*) AS requests, count(*) FILTER (status_code < 300) AS successes,
        count(*) FILTER (status_code >= 300) AS errors FROM requests GROUP BY ALL""",
    ),
)
def stream_counters(spark, sf):
    """Request counters by hour from a stream, in update mode; the last update of a key is its count."""
    events = _stream(spark, sf, "events")
    shaped = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, "get").otherwise("post").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500)
        .when((F.col("event_type") == "click") & (F.col("event_id") % 10 == 0), 404)
        .otherwise(200)
        .alias("status_code"),
    )
    out = work_dir(spark, "stream-counters")
    counted = requests.live_counters(shaped, window="1 hour")

    def keep(batch, batch_id):
        batch.withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    stream = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    keys = ["window", "method", "path", "status_code"]
    last = spark.read.parquet(f"{out}/table").groupBy(*keys).agg(F.max(F.struct("micro_batch", "requests", "successes", "errors")).alias("m"))
    return last.select(
        F.unix_timestamp("window.start").alias("window_start"), "method", "path", "status_code", "m.requests", "m.successes", "m.errors"
    )


