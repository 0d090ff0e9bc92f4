"""Descriptive tables, costs and request statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from holdfast.functions.scalars import round_even
from holdfast.operators import costs, explore, serving
from holdfast.operators.ordering import exact_quantiles
from holdfast.operators.selection import class_shares
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded


@query("class_share", sql_over("customers", 'SELECT "Churn", count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM customers GROUP BY "Churn"'))
def class_share(spark, sf):
    return rounded(class_shares(B.customers(spark, sf), "Churn"))


@query("score_histogram", "SELECT bin, bin / 25.0::DOUBLE AS low, count(*) AS n FROM (SELECT least(CAST(floor(((o_orderkey * 7919) % 1001) / 1000.0::DOUBLE * 25) AS INTEGER), 24) AS bin FROM orders) GROUP BY bin")
def score_histogram(spark, sf):
    scores = B.table(spark, sf, "orders").select((((F.col("o_orderkey") * 7919) % 1001) / 1000.0).alias("p"))
    return explore.score_histogram(scores, "p")


_CATS = ["gender", "Partner", "Contract", "InternetService", "PaymentMethod"]


@query(
    "churn_crosstab",
    sql_over("customers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", "{c}" AS value, "Churn", count(*) AS n FROM customers GROUP BY ALL""" for c in _CATS)),
)
def churn_crosstab(spark, sf):
    return explore.crosstabs(B.customers(spark, sf), "Churn", _CATS)


@query("three_way_counts", sql_over("customers", 'SELECT gender, "Contract", "Churn", count(*) AS n FROM customers GROUP BY ALL'))
def three_way_counts(spark, sf):
    return explore.grouped_counts(B.customers(spark, sf), ["gender", "Contract", "Churn"])


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
        round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem"""
        for c in _NUMBERS
    ),
)
def describe_numeric(spark, sf):
    return rounded(explore.describe_numeric(B.table(spark, sf, "lineitem"), _NUMBERS), 4)


@query(
    "describe_categorical",
    sql_over(
        "customers",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT "{c}" AS v, count(*) AS n FROM customers GROUP BY 1)"""
            for c in _CATS
        ),
    ),
)
def describe_categorical(spark, sf):
    return explore.describe_categorical(B.customers(spark, sf), _CATS)


@query(
    "box_stats",
    sql_over(
        "customers",
        """SELECT "Churn", min(tenure)::DOUBLE AS min, quantile_cont(tenure::DOUBLE, 0.25) AS q25, quantile_cont(tenure::DOUBLE, 0.5) AS q50, quantile_cont(tenure::DOUBLE, 0.75) AS q75, max(tenure)::DOUBLE AS max FROM customers GROUP BY "Churn\"""",
    ),
)
def box_stats(spark, sf):
    return rounded(explore.box_stats(B.customers(spark, sf), "tenure", "Churn"))


@query(
    "label_encode",
    sql_over("customers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", v AS value, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "{c}" AS v FROM customers)""" for c in [*_CATS, "customerID"])),
)
def label_encode(spark, sf):
    return explore.label_codes(B.customers(spark, sf), [*_CATS, "customerID"])


_FACTORS = ["o_orderpriority", "o_orderstatus", "o_custkey"]


@query(
    "factorize",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", v AS value, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT CAST({c} AS VARCHAR) AS v, min(o_orderkey) AS f FROM orders GROUP BY 1)"""
        for c in _FACTORS
    ),
)
def factorize(spark, sf):
    return explore.first_seen_codes(B.table(spark, sf, "orders"), _FACTORS, "o_orderkey")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "churned"]


@query(
    "correlation",
    "WITH li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS churned FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM li" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]
    ),
)
def correlation(spark, sf):
    rows = B.table(spark, sf, "lineitem").withColumn("churned", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(explore.correlations(rows, _CORR))


@query(
    "target_correlation",
    "WITH li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS churned FROM lineitem) SELECT \"column\", corr, row_number() OVER (ORDER BY corr DESC, \"column\") AS place FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS \"column\", round(corr({a}, churned), 6) AS corr FROM li" for a in _CORR if a != "churned")
    + ")",
)
def target_correlation(spark, sf):
    """Columns by their correlation with the target; the place shows the order."""
    rows = B.table(spark, sf, "lineitem").withColumn("churned", (F.col("l_returnflag") == "R").cast("int"))
    found = rounded(explore.target_correlations(rows, "churned", _CORR))
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("corr"), "column")).cast("bigint"))


@query(
    "density",
    sql_over(
        "customers",
        """SELECT "Churn", CAST(i AS INTEGER) AS i, round(x, 5) AS x, round(sum(exp(-0.5::DOUBLE * ((x - v) / bw) * ((x - v) / bw)) / (bw * total * sqrt(2 * pi()))), 5) AS density FROM (
        SELECT *, lo - 3 * bw + i * ((hi - lo + 6 * bw) / 199) AS x FROM (SELECT "Churn", tenure::DOUBLE AS v FROM customers) JOIN
        (SELECT "Churn", count(*) AS total, stddev_samp(tenure) * pow(count(*)::DOUBLE, -0.2) AS bw, min(tenure) AS lo, max(tenure) AS hi FROM customers GROUP BY 1) USING ("Churn")
        CROSS JOIN range(200) r(i)) GROUP BY "Churn", i, x""",
    ),
)
def density(spark, sf):
    return rounded(explore.density(B.customers(spark, sf), "tenure", "Churn"), 5)


# --- costs -------------------------------------------------------------------------------------------------

_WINDOW = """win AS (SELECT count(*) AS run_count, coalesce(sum(cost), 0) AS c, coalesce(sum(duration), 0) AS d, coalesce(arg_max(currency, (start_time, run_id)) FILTER (currency IS NOT NULL), 'EUR') AS currency
FROM runs WHERE start_time >= (SELECT max(start_time) FROM runs) - INTERVAL 7 DAYS)"""
_AVG = "CASE WHEN run_count = 0 THEN 0 ELSE c / run_count END"


def _window(spark, sf):
    runs = B.training_runs(spark, sf)
    newest = runs.agg(F.max("start_time").alias("as_of"))
    return costs.cost_window(runs.join(F.broadcast(newest)), F.col("as_of"))


@query(
    "cost_window",
    sql_over("runs", f"SELECT 7 AS window_days, run_count, round_even(c, 4) AS total_training_cost, round_even(d, 3) AS total_training_duration_seconds, round_even({_AVG}, 6) AS avg_training_cost, round_even(CASE WHEN run_count = 0 THEN 0 ELSE d / run_count END, 3) AS avg_training_duration_seconds, currency FROM win", _WINDOW),
)
def cost_window(spark, sf):
    return rounded(_window(spark, sf), total_training_cost=4)


@query(
    "cost_scenarios",
    sql_over(
        "runs",
        f"""SELECT s.scenario, s.runs_per_month, round_even(round_even({_AVG}, 6) * s.runs_per_month, 4) AS estimated_monthly_cost,
        CASE WHEN run_count = 0 THEN 'none' WHEN round_even({_AVG}, 6) * 30 < 1 THEN 'low' WHEN round_even({_AVG}, 6) * 30 < 20 THEN 'moderate' ELSE 'material' END AS cost_band
        FROM win CROSS JOIN (SELECT unnest(['daily_retraining', 'weekly_retraining', 'drift_triggered_retraining']) AS scenario, unnest([30, 4, 8]) AS runs_per_month) s""",
        _WINDOW,
    ),
)
def cost_scenarios(spark, sf):
    window = _window(spark, sf)
    band = costs.cost_band(window).select("cost_band")
    return rounded(costs.monthly_scenarios(window).join(F.broadcast(band)), 4)


@query("run_costs", sql_over("runs", "SELECT run_id, round_even(duration, 3) AS training_duration_seconds, round_even(duration / 3600 * 0.35::DOUBLE, 6) AS estimated_training_cost FROM runs"))
def run_costs(spark, sf):
    return rounded(costs.with_run_cost(B.training_runs(spark, sf)).select("run_id", "training_duration_seconds", "estimated_training_cost"))


# --- request statistics ------------------------------------------------------------------------------------


@query(
    "latency_percentiles",
    """SELECT path, q AS probability, value AS quantile FROM (SELECT '/' || event_type AS path, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    JOIN (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q) ON i = CAST(round_even((n - 1) * q, 0) AS BIGINT)""",
)
def latency_percentiles(spark, sf):
    return exact_quantiles(B.requests(spark, sf), "latency_ms", serving.PERCENTILES, ["path"], nearest=True)


@query(
    "request_counters",
    sql_over("requests", "SELECT upper(method) AS method, path, status_code, count(*) AS requests, count(*) FILTER (status_code BETWEEN 200 AND 299) AS successes, count(*) FILTER (status_code NOT BETWEEN 200 AND 299) AS errors FROM requests WHERE path <> '/signup' GROUP BY ALL"),
)
def request_counters(spark, sf):
    from holdfast.config import ServingSettings

    settings = ServingSettings(track_paths=(), ignored_paths=("/signup",))
    return serving.request_counters(serving.tracked_requests(B.requests(spark, sf), settings))


_LE = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 3.0, 5.0]


@query(
    "latency_buckets",
    sql_over(
        "requests",
        """SELECT method, path, le, CAST(count(*) FILTER (latency_ms / 1000 <= bound) AS BIGINT) AS n, round(sum(latency_ms / 1000), 4) AS latency_sum FROM requests CROSS JOIN
        (SELECT unnest(%s) AS le, unnest(%s::DOUBLE[]) AS bound) GROUP BY method, path, le"""
        % ([f"{b:g}" for b in _LE] + ["+Inf"], str(_LE)[:-1] + ", 1e300]"),
    ),
)
def latency_buckets(spark, sf):
    return rounded(serving.latency_buckets(B.requests(spark, sf)), 4)


_SLIDING = """win AS (SELECT w * 300 AS w, latency_ms, status_code, path FROM (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) - s AS w, round_even(value, 2) AS latency_ms, status_code, path
FROM (SELECT *, latency_ms AS value FROM requests) CROSS JOIN range(3) r(s)))"""


@query(
    "sliding_summary",
    sql_over(
        "requests",
        """SELECT w AS window_start, count(*) AS requests_total, count(*) FILTER (status_code < 300) AS success_total, count(*) FILTER (status_code >= 300) AS error_total,
        round_even(count(*) FILTER (status_code < 300)::DOUBLE / count(*), 4) AS success_rate, round_even(count(*) FILTER (status_code >= 300)::DOUBLE / count(*), 4) AS error_rate,
        max(latency_ms) FILTER (i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50, max(latency_ms) FILTER (i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS p95,
        max(latency_ms) FILTER (i = CAST(round_even((n - 1) * 0.99, 0) AS BIGINT)) AS p99, round_even(sum(CAST(round_even(latency_ms * 100, 0) AS BIGINT))::DOUBLE / count(*) / 100, 2) AS avg_ms, max(latency_ms) AS max_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY w) AS n FROM win) GROUP BY w""",
        _SLIDING,
    ),
)
def sliding_summary(spark, sf):
    rows = B.requests(spark, sf).withColumn("latency_ms", round_even(F.col("latency_ms"), 2))
    return serving.sliding_summary(rows).withColumn("window_start", F.unix_timestamp("window_start"))


@query("sliding_status_counts", sql_over("requests", "SELECT w AS window_start, status_code, count(*) AS requests FROM win GROUP BY w, status_code", _SLIDING))
def sliding_status_counts(spark, sf):
    return serving.sliding_counts(B.requests(spark, sf), "status_code").withColumn("window_start", F.unix_timestamp("window_start"))
