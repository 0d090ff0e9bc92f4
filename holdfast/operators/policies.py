"""Policy sweeps over labeled predictions: profit floors and uplift assumptions, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.config import CONTACT_UPLIFTS, DISCOUNT_UPLIFTS, PROFIT_FLOORS, DecisionSettings
from holdfast.functions.scalars import drop_nan
from holdfast.operators.metrics import ratio


def _choice(p: Column, s: DecisionSettings, discount_uplift: float, contact_uplift: float) -> tuple[Column, Column]:
    """(is e-mail, best expected value) of the constant-value policy; e-mail wins ties, then discount, then none."""
    email = p * s.customer_value * contact_uplift - s.cost_contact
    discount = p * s.customer_value * discount_uplift - s.cost_discount
    return email >= discount, F.greatest(email, discount, F.lit(0.0))


def labeled_scores(df: DataFrame, y: str = "churn", p: str = "churn_probability") -> DataFrame:
    return df.select(F.col(y).cast("int").alias("y"), drop_nan(F.col(p)).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")


def choose_action(p: Column, floor: float | Column, s: DecisionSettings = DecisionSettings()) -> Column:
    """Action of the profit-floor policy: the best one, unless its value is below the floor."""
    is_email, best = _choice(p, s, s.discount_uplift, s.contact_uplift)
    email = p * s.customer_value * s.contact_uplift - s.cost_contact
    discount = p * s.customer_value * s.discount_uplift - s.cost_discount
    nothing = (email < 0) & (discount < 0)
    return F.when(nothing | (best < floor), "no_action").when(is_email, "send_email").otherwise("offer_discount")


def profit_curve(
    df: DataFrame, y: str = "churn", p: str = "churn_probability", floors: Sequence[float] = PROFIT_FLOORS, s: DecisionSettings = DecisionSettings()
) -> DataFrame:
    """Actions and profit at each profit floor.

    The best action does not depend on the floor, so it is chosen once; a row then counts at every floor up to
    its best value. Rows are reduced to that number of floors, and the curve is a suffix sum over at most
    ``len(floors) + 1`` rows.
    """
    grid = sorted(set(float(f) for f in floors))
    rows = labeled_scores(df, y, p)
    email_ev = F.col("p") * s.customer_value * s.contact_uplift - s.cost_contact
    discount_ev = F.col("p") * s.customer_value * s.discount_uplift - s.cost_discount
    is_email, best = _choice(F.col("p"), s, s.discount_uplift, s.contact_uplift)
    acted = (email_ev >= 0) | (discount_ev >= 0)
    uplift = F.when(is_email, s.contact_uplift).otherwise(s.discount_uplift)
    cost = F.when(is_email, s.cost_contact).otherwise(s.cost_discount)
    # A row with nothing to gain is below every floor.
    reached = F.when(acted, best).otherwise(F.lit(float("-inf")))
    chosen = rows.withColumns(
        {
            "reached": reached,
            "is_email": is_email.cast("int"),
            "expected": F.col("p") * s.customer_value * uplift - cost,
            "realized": F.col("y") * s.customer_value * uplift - cost,
        }
    )
    binned = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="reached", outputCol="_bin").transform(chosen)
    bins = binned.groupBy(F.col("_bin").cast("int").alias("_bin")).agg(
        F.count("*").alias("n"), F.sum("is_email").alias("emails"), F.sum("expected").alias("expected"), F.sum("realized").alias("realized")
    )
    packed = bins.agg(F.sum("n").alias("n_samples"), F.collect_list(F.struct("*")).alias("bins"))
    floor_rows = packed.select(
        "n_samples", "bins", F.posexplode(F.array(*[F.lit(f) for f in grid])).alias("i", "min_expected_profit")
    )

    def total(field: str, kind: str) -> Column:
        return F.aggregate("bins", F.lit(0).cast(kind), lambda acc, b: acc + F.when(b._bin > F.col("i"), b[field]).otherwise(0))

    sums = floor_rows.select(
        "min_expected_profit", "n_samples", total("n", "bigint").alias("actions_count"), total("emails", "bigint").alias("send_email_count"),
        total("expected", "double").alias("expected_profit"), total("realized", "double").alias("realized_profit"),
    )
    return sums.select(
        "min_expected_profit",
        "n_samples",
        "actions_count",
        ratio(F.col("actions_count"), F.col("n_samples")).alias("action_rate"),
        "send_email_count",
        (F.col("actions_count") - F.col("send_email_count")).alias("offer_discount_count"),
        "expected_profit",
        "realized_profit",
        ratio(F.col("expected_profit"), F.col("actions_count")).alias("expected_profit_per_action"),
        ratio(F.col("realized_profit"), F.col("actions_count")).alias("realized_profit_per_action"),
    )


def uplift_grid(
    df: DataFrame,
    y: str = "churn",
    p: str = "churn_probability",
    discounts: Sequence[float] = DISCOUNT_UPLIFTS,
    contacts: Sequence[float] = CONTACT_UPLIFTS,
    s: DecisionSettings = DecisionSettings(),
) -> DataFrame:
    """Actions and realized profit for every pair of uplift assumptions: one aggregate, no row is copied."""
    rows = labeled_scores(df, y, p)
    pairs = [(d, c) for d in discounts for c in contacts]
    sums = []
    for i, (d, c) in enumerate(pairs):
        email = F.col("p") * s.customer_value * c - s.cost_contact
        discount = F.col("p") * s.customer_value * d - s.cost_discount
        is_email, best = _choice(F.col("p"), s, d, c)
        acted = ((email >= 0) | (discount >= 0)) & (best >= s.min_expected_profit)
        profit = F.when(is_email, F.col("y") * s.customer_value * c - s.cost_contact).otherwise(
            F.col("y") * s.customer_value * d - s.cost_discount
        )
        sums += [F.count_if(acted).alias(f"a{i}"), F.coalesce(F.sum(F.when(acted, profit)), F.lit(0.0)).alias(f"r{i}")]
    one = rows.agg(*sums)
    table = F.array(
        *[
            F.struct(
                F.lit(d).alias("discount_uplift"), F.lit(c).alias("contact_uplift"), F.col(f"a{i}").alias("actions"), F.col(f"r{i}").alias("realized_profit")
            )
            for i, (d, c) in enumerate(pairs)
        ]
    )
    return one.select(F.explode(table).alias("g")).select("g.*")


def uplift_pivot(grid: DataFrame, discounts: Sequence[float] = DISCOUNT_UPLIFTS) -> DataFrame:
    """Realized profit as a contact x discount table."""
    return grid.groupBy("contact_uplift").pivot("discount_uplift", list(discounts)).agg(F.first("realized_profit"))


def best_row(table: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """The row with the largest ``value``; the first in ``order`` on ties."""
    return table.orderBy(F.desc(value), *order).limit(1)


def trend(history: DataFrame, moment: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics over time with the change since the previous check. History has one row per check.

    Checks are ordered within months, in parallel. The first of a month takes its predecessor from the last row of the
    latest earlier month that has any, a table of one row per month.
    """
    month = F.date_trunc("month", F.col(moment))
    rows = history.withColumn("_month", month)
    inside = W.partitionBy("_month").orderBy(moment)
    last = rows.groupBy("_month").agg(F.max(F.struct(moment, *[F.col(m).alias(f"_v_{m}") for m in metrics])).alias("_last"))
    before = last.select("_month", F.lag("_last").over(W.orderBy("_month")).alias("_before"))
    placed = rows.withColumns({"_first": F.row_number().over(inside) == 1, **{f"_p_{m}": F.lag(m).over(inside) for m in metrics}})
    joined = placed.join(before, placed["_month"].eqNullSafe(before["_month"]), "left")

    def change(m: str) -> Column:
        return F.col(m) - F.when(F.col("_first"), F.col(f"_before._v_{m}")).otherwise(F.col(f"_p_{m}"))

    return joined.select(*[F.col(f"`{c}`") for c in history.columns], *[change(m).alias(f"{m}_delta") for m in metrics])
