import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.config import CONTACT_UPLIFTS, DISCOUNT_UPLIFTS, PROFIT_FLOORS, DecisionSettings
from holdfast.operators import decisions as D
from holdfast.operators import explain, policies
from holdfast.operators.selection import stratified_split, top_flag


def _batch(spark, n=300, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "prediction": rng.integers(0, 21, n) / 20.0, "customer_value": rng.choice([25.0, 100.0, 400.0], n)})
    return pdf, spark.createDataFrame(pdf)


def _greedy(pdf, s):
    rows = []
    for r in pdf.itertuples():
        discount = r.prediction * (s.discount_uplift * r.customer_value) - s.cost_discount
        email = r.prediction * (s.contact_uplift * r.customer_value) - s.cost_contact
        rows.append((r.id, discount, email, discount - max(email, 0.0)))
    chosen, used = set(), 0.0
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    if s.max_discount_budget:
        for r in order:
            if r[3] > 0:
                if used + s.cost_discount > s.max_discount_budget:
                    break
                chosen.add(r[0])
                used += s.cost_discount
    elif s.max_discount_rate:
        chosen = {r[0] for r in order[: int(len(rows) * s.max_discount_rate)] if r[3] > 0}
    return {r[0]: "offer_discount" if r[0] in chosen else ("send_email" if r[2] >= 0 else "no_action") for r in rows}


@pytest.mark.parametrize(
    "settings",
    [
        DecisionSettings(),
        DecisionSettings(max_discount_budget=9.0),
        DecisionSettings(max_discount_budget=70.0),
        DecisionSettings(max_discount_budget=75.0),
        DecisionSettings(max_discount_budget=1e6),
        DecisionSettings(max_discount_budget=0.0),
        DecisionSettings(max_discount_budget=None, max_discount_rate=0.05),
        DecisionSettings(max_discount_budget=None, max_discount_rate=0.0),
        DecisionSettings(max_discount_budget=50.0, cost_discount=0.0),
    ],
)
def test_batch_decision_matches_the_greedy_rule(spark, settings):
    pdf, df = _batch(spark)
    got = {r.id: r.action for r in D.decide_batch(df, "id", s=settings).select("id", "action").collect()}
    assert got == _greedy(pdf, settings)


def test_zero_email_value_differs_between_single_and_batch(spark):
    df = spark.createDataFrame([(1, 0.2, 100.0)], "id long, prediction double, customer_value double")
    assert D.decide_each(df).first().action == "no_action"
    assert D.decide_batch(df, "id").first().action == "send_email"


def test_empty_batch(spark):
    df = spark.createDataFrame([], "id long, prediction double, customer_value double")
    assert D.decide_batch(df, "id").count() == 0
    assert D.decide_batch(df, "id", s=DecisionSettings(max_discount_budget=None)).count() == 0
    assert D.decision_kpis(D.decide_batch(df, "id")).first().avg_expected_value == 0.0


def test_customer_value_rules(spark):
    df = spark.createDataFrame([("50", "5"), ("50", "12"), (" ", "3"), ("1", None)], "monthlycharges string, tenure string")
    assert [r[0] for r in df.select(D.customer_value(df, 100.0)).collect()] == [600.0, 300.0, 25.0, 25.0]
    bare = df.select("monthlycharges")
    assert bare.select(D.customer_value(bare, 100.0)).first()[0] == 300.0
    none = df.select("tenure")
    assert none.select(D.customer_value(none, 100.0)).first()[0] == 100.0


def test_prioritize_orders_filters_and_cuts(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 9.0), ("c", 5.0), ("d", 1.0), ("e", None)], "id string, expected_value double")
    assert [r.id for r in D.prioritize(df, "id").collect()] == ["b", "a", "c", "d", "e"]
    assert [r.id for r in D.prioritize(df, "id", 2, 2.0).collect()] == ["b", "a"]


def test_profit_curve_and_grid_match_row_by_row(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"churn": rng.integers(0, 2, 200), "churn_probability": rng.integers(0, 41, 200) / 40.0})
    df = spark.createDataFrame(pdf)

    def choose(p, floor, du=0.3, cu=0.1):
        values = {"send_email": p * 100.0 * cu - 2.0, "offer_discount": p * 100.0 * du - 10.0, "no_action": 0.0}
        best = max(values, key=values.get)
        return "no_action" if best == "no_action" or values[best] < floor else best

    curve = {r.min_expected_profit: r for r in policies.profit_curve(df).collect()}
    for floor in PROFIT_FLOORS:
        actions = [choose(p, floor) for p in pdf.churn_probability]
        profit = sum(y * 100 * (0.1 if a == "send_email" else 0.3) - (2 if a == "send_email" else 10) for a, y in zip(actions, pdf.churn) if a != "no_action")
        row = curve[floor]
        assert row.send_email_count == actions.count("send_email") and row.offer_discount_count == actions.count("offer_discount")
        assert row.realized_profit == pytest.approx(profit)
        per_row = df.select(policies.choose_action(F.col("churn_probability"), floor)).collect()
        assert [r[0] for r in per_row] == actions
    for row in policies.uplift_grid(df).collect():
        actions = [choose(p, 0, row.discount_uplift, row.contact_uplift) for p in pdf.churn_probability]
        assert row.actions == sum(a != "no_action" for a in actions)
    assert policies.uplift_grid(df).count() == len(DISCOUNT_UPLIFTS) * len(CONTACT_UPLIFTS)


def test_top_reasons_and_rollup(spark):
    wide = spark.createDataFrame([(1, 0.5, -1.5, 1e-9, 0.5), (2, 0.0, 0.0, 0.0, 0.0)], "id long, a double, b double, c double, d double")
    rows = explain.top_reasons(wide, "id", ["a", "b", "c", "d"], 2).collect()
    assert [(r.id, r.rank, r.feature, r.direction, r.impact_pct) for r in rows] == [(1, 1, "b", "reduces_churn", 60.0), (1, 2, "a", "increases_churn", 20.0)]
    summed = explain.sum_by_source(wide, {"a": "x", "b": "x", "d": "y", "gone": "z"}, ["id"]).collect()
    assert summed[0].x == -1.0 and summed[0].y == 0.5


def test_missing_scores_and_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 100.0), (2, None, 100.0), (3, 0.9, nan), (4, 0.9, None)], "id long, prediction double, customer_value double")
    for decided in (D.decide_each(df), D.decide_batch(df, "id", s=DecisionSettings(max_discount_budget=1000.0))):
        rows = {r.id: (r.action, r.expected_value) for r in decided.collect()}
        assert rows[1] == rows[2] == ("no_action", 0.0)
        assert rows[3] == rows[4] == ("offer_discount", pytest.approx(17.0))


def test_a_share_is_taken_of_all_rows(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 60, F.col("id").cast("double") + 1).alias("v"))
    marked = top_flag(rows, "v", "id", "top", share=0.2)
    assert {r.id for r in marked.where("top").collect()} == set(range(40, 60))
    assert top_flag(rows, "v", "id", "top", k=1000).where("top").count() == 60
    assert top_flag(rows, "v", "id", "top", k=0).where("top").count() == 0
    tied = spark.range(10).select("id", F.lit(1.0).alias("v"))
    assert {r.id for r in top_flag(tied, "v", "id", "top", k=3).where("top").collect()} == {0, 1, 2}
    assert top_flag(rows.limit(0), "v", "id", "top", share=0.5).count() == 0


def test_rows_without_a_class_are_split_as_one(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 4 != 0, (F.col("id") % 2).cast("string")).alias("c"))
    split = stratified_split(rows, "id", "c", 0.2, 1).where("is_validation")
    assert split.count() == 20 and split.where("c IS NULL").count() == 5
