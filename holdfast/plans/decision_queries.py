"""Decisions, campaigns, policy sweeps and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.config import CONTACT_UPLIFTS, DISCOUNT_UPLIFTS, PROFIT_FLOORS
from holdfast.operators import decisions as D
from holdfast.operators import explain, policies
from holdfast.operators.selection import next_batch, seeded_sample
from holdfast.plans import bindings as B
from holdfast.plans.bindings import sql_over
from holdfast.plans.registry import query, rounded

_BATCH = """ranked AS (SELECT *, greatest(v_email, 0) AS fallback, CASE WHEN v_email >= 0 THEN 'send_email' ELSE 'no_action' END AS fallback_action,
row_number() OVER (ORDER BY v_discount - greatest(v_email, 0) DESC, prediction_id) AS rn, count(*) OVER () AS n FROM worth),
decided AS (SELECT *, CASE WHEN rn <= {limit} AND v_discount - fallback > 0 THEN 'offer_discount' ELSE fallback_action END AS action,
CASE WHEN rn <= {limit} AND v_discount - fallback > 0 THEN v_discount ELSE fallback END AS expected_value FROM ranked)"""
_BY_BUDGET = _BATCH.format(limit="20")
_BY_RATE = _BATCH.format(limit="floor(n * 0.2)")
_KPIS = """round_even(sum(expected_value), 2) AS total_expected_value, round_even(sum(expected_value) / count(*), 2) AS avg_expected_value, round_even(sum(customer_value), 2) AS total_customer_value"""


def _decided(spark, sf, s=B.SETTINGS):
    return D.decide_batch(B.scored_orders(spark, sf), "prediction_id", s=s)


@query(
    "action_values",
    sql_over("worth", "SELECT prediction_id, round(v_discount, 6) AS offer_discount, round(v_email, 6) AS send_email, 0.0::DOUBLE AS no_action FROM worth"),
)
def action_values(spark, sf):
    values = D.action_values(F.col("prediction"), F.col("customer_value"), B.SETTINGS)
    rows = B.scored_orders(spark, sf).select("prediction_id", values.alias("v"))
    return rounded(rows.select("prediction_id", *[F.col("v")[a].alias(a) for a in ("offer_discount", "send_email", "no_action")]))


_DECIDED_COLUMNS = """SELECT prediction_id, action, round(expected_value, 6) AS expected_value, CASE WHEN prediction >= 0.5 THEN 1 ELSE 0 END AS churn_prediction FROM decided"""


@query("batch_decision", sql_over("worth", _DECIDED_COLUMNS, _BY_BUDGET))
def batch_decision(spark, sf):
    return rounded(_decided(spark, sf).select("prediction_id", "action", "expected_value", "churn_prediction"))


@query("budget_discounts", sql_over("worth", "SELECT prediction_id, round(expected_value, 6) AS expected_value FROM decided WHERE action = 'offer_discount'", _BY_BUDGET))
def budget_discounts(spark, sf):
    return rounded(_decided(spark, sf).where("action = 'offer_discount'").select("prediction_id", "expected_value"))


@query("rate_discounts", sql_over("worth", "SELECT prediction_id, round(expected_value, 6) AS expected_value FROM decided WHERE action = 'offer_discount'", _BY_RATE))
def rate_discounts(spark, sf):
    return rounded(_decided(spark, sf, B.RATE_SETTINGS).where("action = 'offer_discount'").select("prediction_id", "expected_value"))


@query(
    "decision_kpis",
    sql_over(
        "worth",
        f"""SELECT {_KPIS}, count(*) FILTER (action = 'offer_discount') AS discounts_selected, count(*) FILTER (action = 'send_email') AS emails_selected,
        count(*) FILTER (action = 'no_action') AS no_action_selected, count(*) FILTER (action <> 'no_action') AS actions_count,
        round(avg(CASE WHEN action <> 'no_action' THEN expected_value END), 6) AS expected_value_per_action FROM decided""",
        _BY_BUDGET,
    ),
)
def decision_kpis(spark, sf):
    return rounded(D.decision_kpis(_decided(spark, sf)))


@query(
    "campaign_rollup",
    sql_over(
        "log",
        f"""SELECT 'retention_campaign' AS campaign, count(*) AS targeted_customers, count(*) FILTER (action <> 'no_action') AS actionable_customers, {_KPIS},
        count(*) FILTER (action = 'offer_discount') AS offer_discount, count(*) FILTER (action = 'send_email') AS send_email, count(*) FILTER (action = 'no_action') AS no_action FROM log""",
    ),
)
def campaign_rollup(spark, sf):
    rolled = D.campaign_rollup(B.prediction_log(spark, sf))
    return rounded(_flat_counts(rolled))


def _flat_counts(rolled):
    actions = ("offer_discount", "send_email", "no_action")
    return rolled.withColumns({a: F.col("action_counts")[a] for a in actions}).drop("action_counts")


@query(
    "campaign_run",
    sql_over(
        "worth",
        f"""SELECT 'spring' AS campaign, count(*) AS targeted_customers, count(*) FILTER (action <> 'no_action') AS actionable_customers, {_KPIS},
        count(*) FILTER (action = 'offer_discount') AS offer_discount, count(*) FILTER (action = 'send_email') AS send_email, count(*) FILTER (action = 'no_action') AS no_action
        FROM (SELECT * FROM decided WHERE expected_value >= 1 ORDER BY expected_value DESC, prediction_id LIMIT 1000)""",
        _BY_BUDGET,
    ),
)
def campaign_run(spark, sf):
    """Decide all customers, then roll up the best thousand."""
    best = D.prioritize(_decided(spark, sf), "prediction_id", 1000, 1.0)
    return rounded(_flat_counts(D.campaign_rollup(best, "spring")))


@query("action_share", sql_over("log", "SELECT coalesce(CASE WHEN prediction_id % 10 <> 0 THEN action END, 'unknown') AS action, count(*) AS count FROM log GROUP BY 1"))
def action_share(spark, sf):
    log = B.prediction_log(spark, sf)
    return D.action_distribution(log.withColumn("action", F.when(F.col("prediction_id") % 10 != 0, F.col("action"))))


@query(
    "prioritize",
    sql_over("log", "SELECT prediction_id, round(expected_value, 6) AS expected_value FROM log WHERE expected_value >= 5 ORDER BY log.expected_value DESC, prediction_id LIMIT 100"),
)
def prioritize(spark, sf):
    return rounded(D.prioritize(B.prediction_log(spark, sf), "prediction_id", 100, 5.0).select("prediction_id", "expected_value"))


@query(
    "prioritized_report",
    sql_over(
        "worth",
        """SELECT CAST(o_custkey AS VARCHAR) AS customer_id, prediction AS churn_probability, round(customer_value, 6) AS customer_value, action, round(expected_value, 6) AS expected_value
        FROM decided ORDER BY decided.expected_value DESC, prediction_id LIMIT 50""",
        _BY_BUDGET,
    ),
)
def prioritized_report(spark, sf):
    """Decide, attach ids, and keep the top fifty in the export's columns."""
    rows = B.scored_orders(spark, sf).withColumn("customerid", F.col("c_custkey").cast("string"))
    decided = D.attach_customer_id(D.decide_batch(rows, "prediction_id", s=B.SETTINGS))
    best = D.prioritize(decided, "prediction_id", 50)
    return rounded(best.select("customer_id", "churn_probability", "customer_value", "action", "expected_value"))


_POLICY = "ev AS (SELECT p, y, p * 100 * 0.1::DOUBLE - 2 AS e, p * 100 * 0.3::DOUBLE - 10 AS d FROM pairs)"
_CURVE = """curve AS (SELECT f AS min_expected_profit, count(*) AS n_samples, count(*) FILTER (a) AS actions_count, count(*) FILTER (a AND e >= d) AS send_email_count,
count(*) FILTER (a AND e < d) AS offer_discount_count, coalesce(sum(greatest(e, d)) FILTER (a), 0) AS expected_profit,
coalesce(sum(CASE WHEN e >= d THEN y * 100 * 0.1::DOUBLE - 2 ELSE y * 100 * 0.3::DOUBLE - 10 END) FILTER (a), 0) AS realized_profit
FROM (SELECT *, (e >= 0 OR d >= 0) AND greatest(e, d, 0) >= f AS a FROM ev CROSS JOIN (SELECT unnest([{floors}]::DOUBLE[]) AS f)) GROUP BY f)"""
_CURVE = _CURVE.format(floors=", ".join(str(f) for f in PROFIT_FLOORS))


@query(
    "profit_curve",
    sql_over(
        "pairs",
        """SELECT min_expected_profit, n_samples, actions_count, round(actions_count::DOUBLE / n_samples, 6) AS action_rate, send_email_count, offer_discount_count,
        round(expected_profit, 3) AS expected_profit, round(realized_profit, 3) AS realized_profit,
        round(CASE WHEN actions_count = 0 THEN 0 ELSE expected_profit / actions_count END, 6) AS expected_profit_per_action,
        round(CASE WHEN actions_count = 0 THEN 0 ELSE realized_profit / actions_count END, 6) AS realized_profit_per_action FROM curve""",
        f"{_POLICY}, {_CURVE}",
    ),
)
def profit_curve(spark, sf):
    return rounded(policies.profit_curve(B.labeled_scores(spark, sf)), expected_profit=3, realized_profit=3)


_GRID = """grid AS (SELECT du AS discount_uplift, cu AS contact_uplift, count(*) FILTER (a) AS actions,
coalesce(sum(CASE WHEN e >= d THEN y * 100 * cu - 2 ELSE y * 100 * du - 10 END) FILTER (a), 0) AS realized_profit
FROM (SELECT *, (e >= 0 OR d >= 0) AS a FROM (SELECT *, p * 100 * cu - 2 AS e, p * 100 * du - 10 AS d FROM pairs
CROSS JOIN (SELECT unnest([{du}]::DOUBLE[]) AS du) CROSS JOIN (SELECT unnest([{cu}]::DOUBLE[]) AS cu))) GROUP BY du, cu)"""
_GRID = _GRID.format(du=", ".join(map(str, DISCOUNT_UPLIFTS)), cu=", ".join(map(str, CONTACT_UPLIFTS)))


@query("uplift_grid", sql_over("pairs", "SELECT discount_uplift, contact_uplift, actions, round(realized_profit, 3) AS realized_profit FROM grid", _GRID))
def uplift_grid(spark, sf):
    return rounded(policies.uplift_grid(B.labeled_scores(spark, sf)), realized_profit=3)


@query(
    "uplift_pivot",
    sql_over(
        "pairs",
        "SELECT contact_uplift, " + ", ".join(f'round(sum(realized_profit) FILTER (discount_uplift = {d}::DOUBLE), 3) AS "{d}"' for d in DISCOUNT_UPLIFTS) + " FROM grid GROUP BY contact_uplift",
        _GRID,
    ),
)
def uplift_pivot(spark, sf):
    return rounded(policies.uplift_pivot(policies.uplift_grid(B.labeled_scores(spark, sf))), 3)


@query(
    "best_policy",
    sql_over(
        "pairs",
        """SELECT * FROM (SELECT 'profit_floor' AS policy, min_expected_profit AS setting, round(realized_profit, 3) AS realized_profit FROM curve ORDER BY curve.realized_profit DESC, min_expected_profit LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'discount_uplift', discount_uplift, round(realized_profit, 3) FROM grid ORDER BY grid.realized_profit DESC, discount_uplift, contact_uplift LIMIT 1)""",
        f"{_POLICY}, {_CURVE}, {_GRID}",
    ),
)
def best_policy(spark, sf):
    rows = B.labeled_scores(spark, sf)
    floor = policies.best_row(policies.profit_curve(rows), "realized_profit", ["min_expected_profit"])
    uplift = policies.best_row(policies.uplift_grid(rows), "realized_profit", ["discount_uplift", "contact_uplift"])
    return rounded(
        floor.select(F.lit("profit_floor").alias("policy"), F.col("min_expected_profit").alias("setting"), "realized_profit").unionByName(
            uplift.select(F.lit("discount_uplift").alias("policy"), F.col("discount_uplift").alias("setting"), "realized_profit")
        ),
        realized_profit=3,
    )


_MEANS_SQL = """bg AS (SELECT avg(c_acctbal) AS m1, avg(c_nationkey) AS m2 FROM customer),
imp AS (SELECT c_custkey, unnest(['c_acctbal', 'c_nationkey']) AS feature, unnest([(c_acctbal - m1) * -0.0002::DOUBLE, (c_nationkey - m2) * 0.05::DOUBLE]) AS impact FROM customer, bg),
kept AS (SELECT *, abs(impact) AS size FROM imp WHERE abs(impact) > 1e-6)"""


@query(
    "top_reasons",
    f"""WITH {_MEANS_SQL} SELECT c_custkey, row_number() OVER w AS rank, feature, round(impact, 6) AS impact, CASE WHEN impact > 0 THEN 'increases_churn' ELSE 'reduces_churn' END AS direction,
        round_even(size / sum(size) OVER (PARTITION BY c_custkey) * 100, 2) AS impact_pct FROM kept WINDOW w AS (PARTITION BY c_custkey ORDER BY size DESC, feature)""",
)
def top_reasons(spark, sf):
    """Contributions of a linear model against the mean of all customers, ranked inside each row."""
    customers = B.table(spark, sf, "customer")
    weights = {"c_acctbal": -0.0002, "c_nationkey": 0.05}
    wide = explain.linear_impacts(customers, "c_custkey", weights)
    reasons = explain.top_reasons(wide, "c_custkey", list(weights))
    return rounded(reasons.withColumn("rank", F.col("rank").cast("bigint")))


@query(
    "ohe_rollup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.0 + CASE WHEN l_returnflag = 'N' THEN 0.3 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.7 ELSE 0 END, 6)::DOUBLE AS returnflag,
    round(l_tax * 2, 6) AS tax FROM lineitem""",
)
def ohe_rollup(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    wide = B.table(spark, sf, "lineitem").select(
        *keys,
        F.when(F.col("l_returnflag") == "N", 0.3).otherwise(0.0).alias("returnflag_N"),
        F.when(F.col("l_returnflag") == "R", 0.7).otherwise(0.0).alias("returnflag_R"),
        (F.col("l_tax") * 2).alias("tax"),
    )
    source_of = {"returnflag_N": "returnflag", "returnflag_R": "returnflag", "tax": "tax", "returnflag_X": "returnflag"}
    return rounded(explain.sum_by_source(wide, source_of, keys))


@query("seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || '|42')[1:15], o_orderkey LIMIT 200")
def seeded_sample_query(spark, sf):
    return seeded_sample(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200)


@query(
    "next_batch",
    """SELECT part, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM (
    SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 50 THEN 'batch' ELSE 'rest' END AS part FROM orders) GROUP BY part""",
)
def next_batch_query(spark, sf):
    from holdfast.operators.selection import remainder

    pool = B.table(spark, sf, "orders").select("o_orderkey")
    batch = next_batch(pool, "o_orderkey", 50)
    rest = remainder(pool, batch, "o_orderkey")
    rows = batch.withColumn("part", F.lit("batch")).unionByName(rest.withColumn("part", F.lit("rest")))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))
