"""Retention decisions by expected value, with a limit on discounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DecisionSettings
from holdfast.functions.scalars import drop_nan, first_filled, number_column, over_threshold, round_even
from holdfast.operators.selection import top_flag

NEW_CUSTOMER_MONTHS = 12
NEW_CUSTOMER_HORIZON = 12
OLD_CUSTOMER_HORIZON = 6
VALUE_FLOOR_SHARE = 0.25


def customer_value(df: DataFrame, default: float, monthly: str = "monthlycharges", tenure: str = "tenure") -> Column:
    """Value of a customer: monthly charges over a horizon, never below a quarter of the default."""
    if monthly not in df.columns:
        return F.lit(float(default))
    months: Column = F.lit(OLD_CUSTOMER_HORIZON)
    if tenure in df.columns:
        is_new = F.coalesce(number_column(df, tenure), F.lit(0.0)) < NEW_CUSTOMER_MONTHS
        months = F.when(is_new, NEW_CUSTOMER_HORIZON).otherwise(OLD_CUSTOMER_HORIZON)
    charges = F.coalesce(number_column(df, monthly), F.lit(0.0))
    return F.greatest(charges * months, F.lit(default * VALUE_FLOOR_SHARE))


def discount_value(p: Column, value: Column, s: DecisionSettings) -> Column:
    return p * (s.discount_uplift * value) - s.cost_discount


def email_value(p: Column, value: Column, s: DecisionSettings) -> Column:
    return p * (s.contact_uplift * value) - s.cost_contact


def action_values(p: Column, value: Column, s: DecisionSettings) -> Column:
    """Map of action to expected value."""
    return F.create_map(
        F.lit("offer_discount"), discount_value(p, value, s),
        F.lit("send_email"), email_value(p, value, s),
        F.lit("no_action"), F.lit(0.0),
    )


def decide_each(df: DataFrame, p: str = "prediction", value: str | None = "customer_value", s: DecisionSettings = DecisionSettings()) -> DataFrame:
    """Best action of each row on its own: discount before e-mail before none, and none unless it pays."""
    score = drop_nan(F.col(p))
    worth = F.coalesce(drop_nan(F.col(value)), F.lit(s.customer_value)) if value else F.lit(s.customer_value)
    discount, email = discount_value(score, worth, s), email_value(score, worth, s)
    best = F.greatest(discount, email, F.lit(0.0))
    action = F.when(best <= 0, "no_action").when(discount == best, "offer_discount").otherwise("send_email")
    return df.withColumns({"action": action, "expected_value": best})


def discount_limit(s: DecisionSettings) -> dict | None:
    """How many discounts may be given: by budget if one is set, else a share of the rows, else none. None means no limit."""
    if s.max_discount_budget:
        return {"k": int(s.max_discount_budget // s.cost_discount)} if s.cost_discount else None
    if s.max_discount_rate:
        return {"share": s.max_discount_rate}
    return {"k": 0}


def decide_batch(
    df: DataFrame,
    identity: str,
    p: str = "prediction",
    value: str | None = "customer_value",
    s: DecisionSettings = DecisionSettings(),
    threshold: float = 0.5,
) -> DataFrame:
    """Decide a whole batch: the discounts go to the rows that gain most over their fallback.

    The fallback is an e-mail when it does not lose money, else nothing. Only rows with a positive gain can get
    a discount; ties go to the smaller id.
    """
    score = drop_nan(F.col(p))
    worth = F.coalesce(drop_nan(F.col(value)), F.lit(s.customer_value)) if value else F.lit(s.customer_value)
    discount, email = discount_value(score, worth, s), email_value(score, worth, s)
    valued = df.withColumns(
        {
            "_discount": discount,
            "_fallback": F.greatest(email, F.lit(0.0)),
            "_fallback_action": F.when(email >= 0, "send_email").otherwise("no_action"),
            "all_actions": action_values(score, worth, s),
        }
    ).withColumn("_gain", F.col("_discount") - F.col("_fallback"))
    limit = discount_limit(s)
    if limit is None:
        flagged = valued.withColumn("_chosen", F.col("_gain") > 0)
    else:
        flagged = top_flag(valued, "_gain", identity, "_chosen", **limit)
    return flagged.withColumns(
        {
            "action": F.when(F.col("_chosen"), "offer_discount").otherwise(F.col("_fallback_action")),
            "expected_value": F.when(F.col("_chosen"), F.col("_discount")).otherwise(F.col("_fallback")),
            "churn_probability": score,
            "churn_prediction": over_threshold(score, threshold),
            "decision_threshold": F.lit(float(threshold)),
        }
    ).drop("_discount", "_fallback", "_fallback_action", "_gain", "_chosen")


def prioritize(decided: DataFrame, identity: str, top_n: int | None = None, min_expected_value: float | None = None) -> DataFrame:
    """Rows worth acting on, best first; a top-k of bounded heaps when ``top_n`` is given."""
    rows = decided
    if min_expected_value is not None:
        rows = rows.where(F.coalesce(F.col("expected_value"), F.lit(0.0)) >= min_expected_value)
    ordered = rows.orderBy(F.desc_nulls_last("expected_value"), F.asc(identity))
    return ordered if top_n is None else ordered.limit(top_n)


def _count(action: str) -> Column:
    return F.count_if(F.col("action") == action)


def kpi_columns() -> list[Column]:
    """Business summary of a set of decisions."""
    expected = F.coalesce(F.sum("expected_value"), F.lit(0.0))
    return [
        round_even(expected, 2).alias("total_expected_value"),
        round_even(F.coalesce(F.try_divide(expected, F.count("*")), F.lit(0.0)), 2).alias("avg_expected_value"),
        round_even(F.coalesce(F.sum("customer_value"), F.lit(0.0)), 2).alias("total_customer_value"),
        _count("offer_discount").alias("discounts_selected"),
        _count("send_email").alias("emails_selected"),
        _count("no_action").alias("no_action_selected"),
    ]


def action_columns() -> list[Column]:
    """Number of actions and their mean expected value; NULL if there is none."""
    acted = F.col("action") != "no_action"
    return [
        F.count_if(acted).alias("actions_count"),
        F.avg(F.when(acted, F.col("expected_value"))).alias("expected_value_per_action"),
    ]


def decision_kpis(decided: DataFrame) -> DataFrame:
    """Both summaries in one row, from one pass."""
    return decided.agg(*kpi_columns(), *action_columns())


def campaign_rollup(decided: DataFrame, name: str = "retention_campaign") -> DataFrame:
    """Campaign summary: targeted and actionable customers, totals, and counts by action as a map."""
    expected = F.coalesce(F.sum("expected_value"), F.lit(0.0))
    counts = F.create_map(
        *[part for a in ("offer_discount", "send_email", "no_action") for part in (F.lit(a), _count(a))]
    )
    return decided.agg(
        F.lit(name).alias("campaign"),
        F.count("*").alias("targeted_customers"),
        F.count_if(F.col("action") != "no_action").alias("actionable_customers"),
        round_even(expected, 2).alias("total_expected_value"),
        round_even(F.coalesce(F.try_divide(expected, F.count("*")), F.lit(0.0)), 2).alias("avg_expected_value"),
        round_even(F.coalesce(F.sum("customer_value"), F.lit(0.0)), 2).alias("total_customer_value"),
        counts.alias("action_counts"),
    )


def action_distribution(decided: DataFrame) -> DataFrame:
    return decided.groupBy(F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count("*").alias("count"))


def attach_customer_id(df: DataFrame) -> DataFrame:
    """``customer_id`` from the first filled id spelling present."""
    present = [c for c in ("customerID", "customer_id", "customerid") if c in df.columns]
    return df.withColumn("customer_id", first_filled(*[F.col(c) for c in present]))
