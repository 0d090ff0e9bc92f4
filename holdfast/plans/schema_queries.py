"""Names, validation, coercion, alignment and small row functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import jobs
from holdfast.functions import scalars as S
from holdfast.operators import alignment, naming, validation
from holdfast.operators.selection import stratified_split
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded
from holdfast.session import work_dir


@query("validate_rules", sql_over("failed", "SELECT rule, count(*) AS rows_failed FROM failed WHERE rule IS NOT NULL GROUP BY rule"))
def validate_rules(spark, sf):
    return validation.validation_report(validation.apply_contract(B.contract_rows(spark, sf)))


@query(
    "quarantine_batches",
    sql_over(
        "contract_rows failed",
        """SELECT batch_id, verdict, count(*) AS n FROM (SELECT c.batch_id, CASE WHEN b.batch_id IS NULL THEN 'accepted' ELSE 'quarantined' END AS verdict
        FROM contract_rows c LEFT JOIN (SELECT DISTINCT batch_id FROM failed WHERE rule IS NOT NULL) b USING (batch_id)) GROUP BY batch_id, verdict""",
    ),
)
def quarantine_batches(spark, sf):
    judged = validation.judge_batches(validation.apply_contract(B.contract_rows(spark, sf)), "batch_id")
    verdict = F.when(F.col("accepted"), "accepted").otherwise("quarantined")
    return judged.groupBy("batch_id", verdict.alias("verdict")).agg(F.count("*").alias("n"))


_SPLIT_SQL = """counted AS (SELECT "Churn", count(*) AS c FROM customers GROUP BY 1),
quota AS (SELECT "Churn", floor(s) + CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, "Churn") <= w - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS q
 FROM (SELECT "Churn", ceil(sum(c) OVER () * 0.2) AS w, c * ceil(sum(c) OVER () * 0.2) / sum(c) OVER () AS s FROM counted)),
split AS (SELECT customers.*, row_number() OVER (PARTITION BY "Churn" ORDER BY md5("customerID" || '|42')[1:15], "customerID") <= q AS is_validation
 FROM customers JOIN quota USING ("Churn"))"""


@query("stratified_split", sql_over("customers", 'SELECT "customerID", "Churn", is_validation FROM split', _SPLIT_SQL))
def stratified_split_query(spark, sf):
    return stratified_split(B.customers(spark, sf), "customerID", "Churn", 0.2, 42).select("customerID", "Churn", "is_validation")


@query(
    "ingest_train",
    sql_over(
        "customers contract_rows failed",
        """SELECT "customerID", gender, tenure, "Churn", source FROM (
        SELECT "customerID", gender, tenure, "Churn", 'base' AS source FROM split WHERE NOT is_validation
        UNION ALL SELECT 'b' || "customerID", gender, CAST(tenure AS BIGINT), "Churn", 'batch' FROM contract_rows
        WHERE batch_id NOT IN (SELECT batch_id FROM failed WHERE rule IS NOT NULL))""",
        _SPLIT_SQL,
    ),
)
def ingest_train(spark, sf):
    """Kept part of the base split plus every accepted batch."""
    base = naming.normalize_raw(B.customers(spark, sf))
    kept = stratified_split(base, "customerID", "Churn", 0.2, 42).where("NOT is_validation")
    good, _ = validation.split_batches(validation.apply_contract(B.contract_rows(spark, sf)), "batch_id")
    batches = good.withColumns({"customerID": F.concat(F.lit("b"), "customerID"), "source": F.lit("batch")})
    merged = kept.drop("is_validation").withColumn("source", F.lit("base")).unionByName(batches, allowMissingColumns=True)
    return merged.select("customerID", "gender", "tenure", "Churn", "source")


_GROWTH_SQL = sql_over(
    "contract_rows failed",
    """SELECT customer, place FROM (
    SELECT 'b' || "customerID" AS customer, 'base' AS place FROM contract_rows WHERE "customerID" IS NOT NULL AND "customerID" NOT IN (SELECT "customerID" FROM failed WHERE rule IS NOT NULL AND "customerID" IS NOT NULL)
    UNION ALL SELECT "customerID", CASE WHEN batch_id IN (SELECT batch_id FROM failed WHERE rule IS NOT NULL) THEN 'quarantine' ELSE 'accepted' END FROM contract_rows)""",
)


@query("ingest_growth", _GROWTH_SQL)
def ingest_growth(spark, sf):
    """The ingest job on a base table that grows between two runs: every row is in exactly one place."""
    folder = work_dir(spark, "ingest")
    rows = B.contract_rows(spark, sf)
    valid = validation.apply_contract(rows).where(F.size("failed_rules") == 0).drop("failed_rules")
    base = valid.withColumn("customerID", F.concat(F.lit("b"), "customerID"))
    early, columns = F.col("batch_id") < 20, [c for c in rows.columns if c != "batch_id"]
    batches = rows.withColumnRenamed("batch_id", "batch_file")
    jobs.ingest_job(spark, base.where(early).select(columns), batches.where(F.col("batch_file") < 20), folder)
    table = jobs.ingest_job(spark, base.select(columns), batches, folder)
    of_base = F.col("customerID").startswith("b")
    held = spark.read.parquet(f"{folder}/holdout").select("customerID", F.lit("base").alias("place"))
    kept = table.select("customerID", F.when(of_base, "base").otherwise("accepted").alias("place"))
    bad = jobs.quarantined(spark, folder).select("customerID", F.lit("quarantine").alias("place"))
    return held.unionAll(kept).unionAll(bad).withColumnRenamed("customerID", "customer")


@query(
    "normalize_names",
    """SELECT CAST(c_custkey AS VARCHAR) AS customerid, c_acctbal AS account_balance_eur, c_mktsegment AS market_segment, c_name AS full_name FROM customer""",
)
def normalize_names(spark, sf):
    raw = B.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("customerID"),
        F.col("c_acctbal").alias(" Account Balance (EUR)"),
        F.col("c_mktsegment").alias("Market Segment"),
        F.col("c_name").alias("FULL NAME"),
    )
    return naming.feature_names(naming.to_log_id(naming.normalize_raw(raw)))


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::VARCHAR AS o_orderdate FROM orders")
def drop_columns(spark, sf):
    kept = naming.drop_present(B.table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "not_there"])
    return kept.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


_ALIGN = T.StructType(
    [
        T.StructField("tenure", T.LongType()),
        T.StructField("MonthlyCharges", T.DoubleType()),
        T.StructField("TotalCharges", T.DoubleType()),
        T.StructField("promo_count", T.LongType()),
        T.StructField("SeniorCitizen", T.BooleanType()),
        T.StructField("customerID", T.StringType()),
    ]
)


@query(
    "align_features",
    sql_over(
        "customers",
        """SELECT tenure, round("MonthlyCharges", 6) AS "MonthlyCharges", coalesce(TRY_CAST("TotalCharges" AS DOUBLE), 0) AS "TotalCharges",
        CAST(0 AS BIGINT) AS promo_count, "SeniorCitizen" = 1 AS "SeniorCitizen", "customerID" FROM customers""",
    ),
)
def align_features(spark, sf):
    return rounded(alignment.align(B.customers(spark, sf), _ALIGN))


@query(
    "cast_schema",
    """SELECT l_quantity <> 0 AS l_quantity, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS l_extendedprice, l_discount, CAST(l_orderkey AS VARCHAR) AS l_orderkey FROM lineitem""",
)
def cast_schema(spark, sf):
    schema = T.StructType(
        [
            T.StructField("l_quantity", T.BooleanType()),
            T.StructField("l_extendedprice", T.LongType()),
            T.StructField("l_discount", T.DoubleType()),
            T.StructField("l_orderkey", T.StringType()),
            T.StructField("not_there", T.DoubleType()),
        ]
    )
    return alignment.cast_to_schema(B.table(spark, sf, "lineitem"), schema)


@query(
    "numeric_coerce",
    sql_over(
        "customers",
        """SELECT "customerID", TRY_CAST("TotalCharges" AS DOUBLE) AS kept, coalesce(TRY_CAST("TotalCharges" AS DOUBLE), 0) AS filled,
        TRY_CAST("Contract" AS DOUBLE) AS text_value FROM customers""",
    ),
)
def numeric_coerce(spark, sf):
    return B.customers(spark, sf).select(
        "customerID",
        S.to_number(F.col("TotalCharges")).alias("kept"),
        S.to_number_or_zero(F.col("TotalCharges")).alias("filled"),
        S.to_number(F.col("Contract")).alias("text_value"),
    )


@query(
    "target_normalize",
    """SELECT spelled, count(*) AS n, max(s) AS strict_target, max(t) AS training_target, max(l) AS label_target FROM (
    SELECT spelled, CASE WHEN lower(trim(spelled)) IN ('yes','y','true','1','churn') THEN 1 ELSE 0 END AS s,
    CASE WHEN lower(spelled) = 'yes' THEN 1 ELSE 0 END AS t, CASE WHEN lower(trim(spelled)) IN ('yes','1') THEN 1 WHEN lower(trim(spelled)) IN ('no','0') THEN 0 END AS l
    FROM (SELECT CASE l_linenumber % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'No Churn' END AS spelled FROM lineitem)) GROUP BY spelled""",
)
def target_normalize(spark, sf):
    n = F.col("l_linenumber") % 5
    spelled = F.when(n == 0, " Yes ").when(n == 1, "no").when(n == 2, "TRUE").when(n == 3, "0").otherwise("No Churn")
    rows = B.table(spark, sf, "lineitem").select(spelled.alias("spelled"))
    targets = rows.select(
        "spelled",
        S.strict_binary_target(F.col("spelled")).alias("s"),
        S.training_target(F.col("spelled")).alias("t"),
        S.label_target(F.col("spelled")).alias("l"),
    )
    return targets.groupBy("spelled").agg(
        F.count("*").alias("n"), F.max("s").alias("strict_target"), F.max("t").alias("training_target"), F.max("l").alias("label_target")
    )


@query(
    "request_paths",
    """SELECT path, ok, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('view', 'purchase', 'error') THEN '/' || event_type ELSE 'other' END AS path,
    event_type <> 'error' AS ok FROM events WHERE event_type <> 'signup') GROUP BY path, ok""",
)
def request_paths(spark, sf):
    path = F.concat(F.lit("/"), F.col("event_type"))
    rows = B.table(spark, sf, "events").where(~path.isin("/signup"))
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    shown = rows.select(S.tracked_path(path, ("/view", "/purchase", "/error")).alias("path"), S.is_success(status).alias("ok"))
    return shown.groupBy("path", "ok").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k bigint").getField("k").alias("k"), F.get_json_object("props", "$.missing").alias("missing")
    )


@query(
    "timestamps",
    """SELECT l_shipdate::DATE AS day, min(l_shipdate)::VARCHAR AS first_at, max(l_shipdate)::VARCHAR AS last_at, count(TRY_CAST(txt AS TIMESTAMP)) AS parsed, count(*) AS n
    FROM (SELECT l_shipdate, CASE WHEN l_partkey % 10 = 0 THEN 'not a time' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS txt FROM lineitem) GROUP BY 1""",
)
def timestamps(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        "l_shipdate",
        F.when(F.col("l_partkey") % 10 == 0, "not a time").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("txt"),
    )
    return rows.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.min("l_shipdate").cast("string").alias("first_at"),
        F.max("l_shipdate").cast("string").alias("last_at"),
        F.count(S.to_utc_timestamp(F.col("txt"))).alias("parsed"),
        F.count("*").alias("n"),
    )


@query(
    "scalar_pack",
    """SELECT c_custkey, least(greatest(c_acctbal / 5000, 0), 1) AS clipped, CASE WHEN c_acctbal / 5000 >= 0.5 THEN 1 ELSE 0 END AS above,
    lower(trim(c_mktsegment)) AS segment, starts_with(c_name, 'Customer') AS named, CASE WHEN c_custkey % 2 = 0 THEN 'No' ELSE 'Yes' END AS yes_no,
    coalesce(CASE WHEN c_nationkey > 12 THEN c_mktsegment END, 'MISSING') AS category FROM customer""",
)
def scalar_pack(spark, sf):
    share = F.col("c_acctbal") / 5000
    return B.table(spark, sf, "customer").select(
        "c_custkey",
        S.clip(share).alias("clipped"),
        S.over_threshold(share, 0.5).alias("above"),
        F.lower(F.trim("c_mktsegment")).alias("segment"),
        F.startswith("c_name", F.lit("Customer")).alias("named"),
        S.yes_no(F.col("c_custkey") % 2).alias("yes_no"),
        S.category_text(F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")), "MISSING").alias("category"),
    )


@query(
    "numeric_input",
    sql_over(
        "customers",
        """SELECT c_custkey::DOUBLE AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS flag, coalesce(TRY_CAST("TotalCharges" AS DOUBLE), 0.0) AS "TotalCharges",
        CASE "Contract" WHEN 'Month-to-month' THEN 0.0 WHEN 'One year' THEN 1.0 WHEN 'Two year' THEN 2.0 ELSE -1.0 END::DOUBLE AS "Contract" FROM customers""",
    ),
)
def numeric_input(spark, sf):
    c = B.customers(spark, sf).select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("flag"), "TotalCharges", "Contract")
    return alignment.numeric_input(c, {"Contract": ["Month-to-month", "One year", "Two year"]})


@query(
    "coalesce_ids",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_custkey % 3 = 1 THEN 'alt-' || o_custkey ELSE 'low-' || o_custkey END AS customer_id FROM orders""",
)
def coalesce_ids(spark, sf):
    k, text = F.col("o_custkey") % 3, F.col("o_custkey").cast("string")
    rows = B.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k == 0, text).when(k == 1, "").alias("id_raw"),
        F.when(k == 1, F.concat(F.lit("alt-"), text)).alias("id_request"),
        F.concat(F.lit("low-"), text).alias("id_log"),
    )
    return rows.select("o_orderkey", S.first_filled(F.col("id_raw"), F.col("id_request"), F.col("id_log")).alias("customer_id"))


_RELEASED = ", ".join(
    f'"{n}"' if n in ("customerID", "gender", "SeniorCitizen", "Partner", "tenure", "InternetService", "Contract", "PaymentMethod", "TotalCharges", "Churn")
    else 'round("MonthlyCharges", 6) AS "MonthlyCharges"' if n == "MonthlyCharges" else f"'No' AS \"{n}\""
    for n in validation.RAW_COLUMNS
)


@query("training_release", sql_over("customers", f"SELECT {_RELEASED} FROM customers"))
def training_release(spark, sf):
    c = B.customers(spark, sf)
    filled = c.withColumns({n: F.lit("No") for n in validation.RAW_COLUMNS if n not in c.columns})
    released = validation.release_columns(filled)
    return rounded(released)


@query("version_id", "SELECT DISTINCT strftime(o_orderdate, 'ds_%Y%m%d_%H%M%S') AS version FROM orders")
def version_id(spark, sf):
    return B.table(spark, sf, "orders").select(S.version_id(F.col("o_orderdate")).alias("version")).distinct()

