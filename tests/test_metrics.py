import math

import numpy as np
import pandas as pd
import pytest

from holdfast.config import DecisionSettings
from holdfast.operators import metrics as M


def _frame(spark, rows, schema="Churn string, churn_probability double"):
    return spark.createDataFrame(rows, schema)


def test_perfect_classifier(spark, one):
    df = _frame(spark, [("No", 0.1), ("Yes", 0.8), ("Yes", 0.7), ("No", 0.3)])
    m = one(M.classification_metrics(df))
    for name in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"):
        assert m[name] == pytest.approx(1.0)
    assert (m["true_negatives"], m["true_positives"], m["false_negatives"], m["false_positives"]) == (2, 2, 0, 0)
    assert m["predicted_churn_rate"] == m["actual_churn_rate"] == 0.5


def test_missing_column_and_no_rows_are_errors(spark):
    with pytest.raises(KeyError):
        M.classification_metrics(spark.createDataFrame([("Yes",)], "Churn string"))
    with pytest.raises(Exception, match="lacks a label"):
        M.classification_metrics(_frame(spark, [(None, 0.1), ("Yes", None), ("No", math.nan)])).collect()


def test_unknown_target_fails_with_the_value(spark):
    with pytest.raises(Exception, match="Neither a yes nor a no: perhaps"):
        M.classification_metrics(_frame(spark, [("perhaps", 0.1), ("Yes", 0.4)])).collect()


def test_one_class_has_no_ranking_metrics(spark, one):
    m = one(M.classification_metrics(_frame(spark, [("Yes", 0.2), ("yes ", 0.9)])))
    assert m["roc_auc"] is None and m["pr_auc"] is None and m["log_loss"] is None
    assert m["brier_score"] == pytest.approx((0.64 + 0.01) / 2)


def test_scores_outside_the_unit_interval_are_clipped(spark, one):
    m = one(M.classification_metrics(_frame(spark, [("Yes", 1.7), ("No", -2.0)])))
    assert m["brier_score"] == 0.0 and m["avg_churn_probability"] == 0.5


def test_score_at_the_threshold_counts_as_churn(spark, one):
    m = one(M.classification_metrics(_frame(spark, [("Yes", 0.5), ("No", 0.4)])))
    assert m["true_positives"] == 1


def test_ranking_metrics_match_brute_force_with_ties(spark, one):
    rng = np.random.default_rng(5)
    p, y = rng.integers(0, 50, 800) / 50.0, rng.integers(0, 2, 800)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": p}))
    m = one(M.classification_metrics(df, "y", "s", numeric_target=True))
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        hits, total = (y[p >= t]).sum(), (p >= t).sum()
        ap += (hits - seen) / y.sum() * hits / total
        seen = hits
    q = np.clip(p, M.LOG_LOSS_EPS, 1 - M.LOG_LOSS_EPS)
    assert m["roc_auc"] == pytest.approx(auc)
    assert m["pr_auc"] == pytest.approx(ap)
    assert m["log_loss"] == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    assert m["brier_score"] == pytest.approx(((p - y) ** 2).mean())


@pytest.mark.parametrize("scale", [1.0, 0.05, 0.3])
def test_best_threshold_matches_81_passes(spark, one, scale):
    rng = np.random.default_rng(6)
    p, y = rng.random(300) * scale, rng.integers(0, 2, 300)
    labeled = M.labeled_rows(spark.createDataFrame(pd.DataFrame({"y_": y, "s": p})), "y_", "s", numeric_target=True)
    best, score = 0.5, -1.0
    for t in np.arange(0.10, 0.91, 0.01):
        h = (p >= t).astype(int)
        f1 = 2 * (h * y).sum() / (h.sum() + y.sum()) if h.sum() + y.sum() else 0.0
        if f1 > score:
            best, score = t, f1
    m = one(M.best_threshold(labeled))
    assert m["best_threshold"] == pytest.approx(best) and m["best_f1"] == pytest.approx(score)


def test_threshold_grid_is_the_numpy_grid():
    assert list(M.THRESHOLD_GRID) == np.arange(0.10, 0.91, 0.01).tolist()


def test_business_metrics_by_hand(spark, one):
    rows = [("Yes", 0.9, "offer_discount", 200.0), ("No", 0.5, "send_email", 100.0), ("No", 0.1, "no_action", 100.0), ("Yes", 0.8, "call", 100.0)]
    df = _frame(spark, rows, "Churn string, churn_probability double, action string, customer_value double")
    m = one(M.business_metrics(df))
    assert m["intervention_rate"] == 0.75 and m["total_intervention_cost"] == 12.0
    assert m["expected_saved_value"] == pytest.approx(0.9 * 200 * 0.3 + 0.5 * 100 * 0.1)
    assert m["realized_saved_value"] == pytest.approx(60.0) and m["realized_profit"] == pytest.approx(48.0)
    assert m["actual_intervened_churners"] == 2
    assert m["realized_profit_per_action"] == pytest.approx((50.0 - 2.0 + 0.0) / 3)
    constant = one(M.business_metrics(df, value=None, settings=DecisionSettings()))
    assert constant["realized_saved_value"] == pytest.approx(30.0)


def test_class_report_by_hand(spark):
    labeled = M.labeled_rows(_frame(spark, [("Yes", 0.9), ("Yes", 0.2), ("No", 0.1), ("No", 0.7), ("No", 0.3)]), "Churn", "churn_probability")
    rows = {r.label: r for r in M.class_report(labeled).collect()}
    assert rows["1"].precision == 0.5 and rows["1"].recall == 0.5 and rows["0"].support == 3
    assert rows["accuracy"].f1 == pytest.approx(0.6)
    assert rows["macro avg"].precision == pytest.approx((2 / 3 + 0.5) / 2)
    assert rows["weighted avg"].precision == pytest.approx((2 / 3 * 3 + 0.5 * 2) / 5)


def test_a_numeric_target_must_be_0_or_1(spark):
    rows = spark.createDataFrame([(0, 0.1), (2, 0.9)], "y int, p double")
    with pytest.raises(Exception, match="Neither a yes nor a no: 2"):
        M.classification_metrics(rows, "y", "p", numeric_target=True).collect()
