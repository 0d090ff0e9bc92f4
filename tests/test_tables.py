"""Validation, names, alignment, features, quality and drift."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import DEFAULT_STEPS, FeatureSettings
from holdfast.functions import scalars as S
from holdfast.functions.stats import kolmogorov_tail, with_chi_square_tail
from holdfast.operators import alignment, drift, explore, features, naming, quality, validation
from holdfast.plans.drift_queries import CHI_TAIL

GOOD = {
    "customerID": "K-0417", "gender": "Male", "SeniorCitizen": "0", "Partner": "No", "Dependents": "Yes", "tenure": "12",
    "PhoneService": "No", "MultipleLines": "No phone service", "InternetService": "DSL", "OnlineSecurity": "Yes", "OnlineBackup": "No",
    "DeviceProtection": "Yes", "TechSupport": "Yes", "StreamingTV": None, "StreamingMovies": "Yes", "Contract": "Two year",
    "PaperlessBilling": "No", "PaymentMethod": "Bank transfer", "MonthlyCharges": "41.9", "TotalCharges": " ", "Churn": "Yes",
}


def customers(spark, *changes, drop=()):
    names = [n for n in GOOD if n not in drop]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple({**GOOD, **c}[n] for n in names) for c in changes], schema)


@pytest.mark.parametrize(
    "column,value",
    [("gender", "f"), ("SeniorCitizen", "7"), ("Partner", "perhaps"), ("Dependents", "none"), ("PhoneService", "y"), ("MultipleLines", "three"),
     ("PaperlessBilling", "0"), ("tenure", "-3"), ("tenure", "1.5"), ("tenure", "x"), ("InternetService", "satellite"), ("Contract", "daily"),
     ("MonthlyCharges", "-0.5"), ("MonthlyCharges", "nan"), ("Churn", "later"), ("customerID", None)],
)
def test_bad_values_are_found(spark, column, value):
    row = validation.apply_contract(customers(spark, {column: value})).first()
    assert len(row.failed_rules) == 1 and row.failed_rules[0].startswith(column + ":")
    with pytest.raises(Exception, match="Validation failed"):
        validation.validate_or_fail(customers(spark, {column: value})).collect()


def test_good_rows_are_coerced(spark):
    checked = validation.validate_or_fail(customers(spark, {}).withColumn("extra", F.lit(1)))
    row = checked.first()
    assert (row.tenure, row.MonthlyCharges, row.SeniorCitizen, row.extra) == (12, 41.9, 0, 1)
    assert dict(checked.dtypes)["tenure"] == "bigint"


def test_optional_and_required_columns(spark):
    assert validation.apply_contract(customers(spark, {}, drop=("Churn", "TotalCharges"))).first().failed_rules == []
    with pytest.raises(KeyError, match="tenure"):
        validation.apply_contract(customers(spark, {}, drop=("tenure",)))
    checked = validation.apply_contract(customers(spark, {"Churn": "Maybe"}), validation.inference_contract())
    assert checked.first().failed_rules == []
    with pytest.raises(ValueError):
        validation.require_rows(customers(spark))


def test_one_bad_row_rejects_its_batch(spark):
    df = customers(spark, {}, {"tenure": "-1"}, {}).withColumn("b", F.when(F.col("tenure") == "-1", 1).otherwise(2))
    df = df.unionByName(customers(spark, {}).withColumn("b", F.lit(1)))
    good, bad = validation.split_batches(validation.apply_contract(df), "b")
    assert {r.b for r in good.collect()} == {2} and bad.count() == 2 and good.count() == 2


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["Total Charges (EUR)", " customerID"])
    assert naming.feature_names(df).columns == ["total_charges_eur", "customerid"]
    assert naming.request_names(df).columns == ["total_charges_(eur)", "_customerid"]
    raw = spark.createDataFrame([("a", 5.5)], ["customerid", "TotalCharges"])
    assert naming.normalize_raw(raw).columns == ["customerID", "TotalCharges"]
    assert naming.to_log_id(naming.normalize_raw(raw)).columns == ["customerid", "TotalCharges"]
    assert naming.drop_present(raw, ["customerid", "zzz"]).columns == ["TotalCharges"]


def test_numbers_and_targets(spark):
    df = spark.createDataFrame([(" ",), ("1.5",), (" 2 ",), ("nan",), ("x",), ("3d",), (None,), ("1e2",)], "v string")
    assert [r[0] for r in df.select(S.to_number(F.col("v"))).collect()] == [None, 1.5, 2.0, None, None, None, None, 100.0]
    assert [r[0] for r in df.select(S.to_number_or_zero(F.col("v"))).collect()] == [0.0, 1.5, 2.0, 0.0, 0.0, 0.0, 0.0, 100.0]
    words = spark.createDataFrame([(" Yes",), ("no churn",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in words.select(S.binary_target(F.col("v"))).collect()] == [1, 0, None, None]
    assert [r[0] for r in words.select(S.training_target(F.col("v"))).collect()] == [0, 0, 0, 0]
    assert [r[0] for r in words.select(S.label_target(F.col("v"))).collect()] == [1, None, None, None]
    numbers = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "v double")
    assert [r[0] for r in numbers.select(S.round_even(F.col("v"), 2)).collect()] == [0.12, 0.38, 2.5]


def test_one_hot_drops_the_first_level_and_keeps_the_vocabulary(spark):
    train = spark.createDataFrame([("One year", "a (b)", 1), ("Two year", None, 2), ("Month-to-month", "c d", 3)], "contract string, x string, n int")
    model = features.fit_one_hot(train, ["contract", "x"])
    assert model.output_columns() == ["contract_One year", "contract_Two year", "x_c d"]
    out = model.transform(spark.createDataFrame([("Weekly", "c d", 5), (None, None, 6), ("One year", "a (b)", 7)], train.schema))
    assert out.columns == ["n", "contract_One year", "contract_Two year", "x_c d"]
    assert [tuple(r) for r in out.collect()] == [(5, False, False, True), (6, False, False, False), (7, True, False, False)]
    assert features.OneHotModel.from_json(model.to_json()) == model
    assert features.fit_one_hot(train.where("n = 1"), ["contract"]).output_columns() == []


def test_feature_pipeline(spark):
    settings = FeatureSettings(categorical_columns=("gender", "contract"), drop_columns=("customerid",))
    raw = spark.createDataFrame([("1", "Male", "One year", " "), ("2", "Female", "Month-to-month", "9.5")], "customerID string, gender string, Contract string, TotalCharges string")
    out = features.build_features(raw, settings)
    assert out.columns == ["totalcharges", "gender_Male", "contract_One year"]
    assert dict(out.dtypes)["gender_Male"] == "boolean" and out.first().totalcharges == 0.0
    with pytest.raises(ValueError, match="no feature step"):
        features.build_features(raw, settings, steps=["nope"])
    assert features.build_features(raw, settings, steps=["clean_names"]).columns == ["customerid", "gender", "contract", "totalcharges"]
    assert DEFAULT_STEPS[0] == "cast_numeric_types"


def test_standardize_and_fill(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    scaled, other = features.standardize(train, ["a", "b"], spark.createDataFrame([(5.0, 6.0)], "a double, b double"))
    assert [tuple(r) for r in scaled.collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert tuple(other.first()) == (3.0, 1.0)
    assert [r.a for r in features.fill_with_mean(train, ["a"]).collect()] == [1.0, 3.0, 2.0]


def test_alignment(spark):
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("flag_x y", T.BooleanType())])
    df = spark.createDataFrame([("7", "x", 1)], "a string, b string, c int")
    out = alignment.align(df, schema)
    assert out.columns == ["b", "a", "flag_x y"] and tuple(out.first()) == (0, 7.0, False)
    back = alignment.cast_to_schema(spark.createDataFrame([(2.5, 0.2, 0.0)], ["b", "a", "flag_x y"]), schema)
    assert tuple(back.first()) == (2, 0.2, False)
    assert alignment.load_schema(alignment.capture_schema(out)) == out.schema
    numbers = alignment.numeric_input(spark.createDataFrame([(True, "m", "1.5", None)], "t boolean, c string, s string, z double"), {"c": ["k", "m"]})
    assert tuple(numbers.first()) == (1.0, 1.0, 1.5, 0.0)


def test_quality(spark, one):
    ref = spark.createDataFrame([("a", "p"), ("b", None)], "x string, y string")
    cur = spark.createDataFrame([("a", 1.0)] + [(f"n{i:02d}", math.nan) for i in range(25)], "x string, v double").withColumn("y", F.lit("p"))
    known = quality.category_reference(ref, ["x", "y"])
    rows = {r.feature: r for r in quality.unseen_categories(cur, known, ["x", "y"]).collect()}
    assert rows["x"].unseen_category_count == 25 and rows["x"].unseen_categories == ",".join(f"n{i:02d}" for i in range(20))
    assert rows["y"].unseen_category_count == 0 and rows["y"].unseen_categories == ""
    assert {r.column: r.missing_rate for r in quality.missing_rates(cur).collect()} == {"x": 0.0, "y": 0.0, "v": pytest.approx(25 / 26)}
    assert one(quality.quality_status(cur, known, ["x"]))["quality_status"] == "warning"
    assert one(quality.quality_status(cur.where("x = 'a'"), known, ["x"]))["quality_status"] == "ok"
    assert one(quality.quality_status(cur.where("x = 'zz'"), known, ["x"]))["quality_status"] == "empty"
    assert one(quality.quality_status(cur, known, ["x"], enabled=False))["quality_status"] == "disabled"


def _ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()


def test_numeric_drift(spark):
    rng = np.random.default_rng(9)
    ref, cur = rng.normal(size=400), rng.normal(0.5, 1, 300)
    r = spark.createDataFrame(pd.DataFrame({"a": ref, "b": ref, "few": [1.0] * 49 + [math.nan] * 351}))
    c = spark.createDataFrame(pd.DataFrame({"a": cur, "b": ref[:300], "few": cur}))
    rows = {x.feature: x for x in drift.drift_report(r, c, ["a", "b", "few", "gone"], []).collect()}
    assert rows["a"].score == pytest.approx(_ks(ref, cur)) and rows["a"].drift_detected and (rows["a"].reference_n, rows["a"].current_n) == (400, 300)
    assert not rows["b"].drift_detected and rows["b"].score == pytest.approx(_ks(ref, ref[:300]))
    assert rows["few"].reason == "insufficient_samples" and rows["few"].score == 0.0 and rows["few"].p_value == 1.0 and rows["few"].reference_n == 49
    assert set(rows) == {"a", "b", "few"}


def test_identical_samples_do_not_drift(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("v"))
    row = drift.drift_report(df, df, ["v"], []).first()
    assert row.score == 0.0 and row.p_value == 1.0 and not row.drift_detected


def test_categorical_drift(spark):
    r = spark.createDataFrame([("a",)] * 60 + [("b",)] * 30 + [(None,)] * 10, "c string")
    c = spark.createDataFrame([("a",)] * 30 + [("b",)] * 25 + [(None,)] * 5, "c string")
    row = drift.drift_report(r, c, [], ["c"]).first()
    stat = sum((o - e) ** 2 / e for o, e in [(30, 36), (25, 18), (5, 6)])
    assert row.score == pytest.approx(stat) and row.p_value == pytest.approx(math.exp(-stat / 2)) and not row.drift_detected
    new = drift.drift_report(r, c.union(spark.createDataFrame([("z",)], "c string")), [], ["c"])
    assert new.first().drift_detected and new.first().score > 1e6
    summary = drift.drift_summary(new).first()
    assert summary.checked_features == 1 and summary.drifted_feature_names == ["c"] and summary.drift_detected


def test_tail_probabilities(spark):
    def chi(x, dof):
        return with_chi_square_tail(spark.createDataFrame([(float(x), dof)], "x double, k int"), "x", "k", "p").first().p

    for x in (0.01, 0.5, 3.84, 20.0, 200.0):
        assert chi(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
        assert chi(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert chi(x, 3) == pytest.approx(math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2), rel=1e-9)
    assert chi(11.07049769, 5) == pytest.approx(0.05, rel=1e-6) and chi(5.0, 0) == 1.0 and chi(1e12, 4) == 0.0
    ks = spark.range(1).select(kolmogorov_tail(F.lit(0.1), F.lit(200), F.lit(200))).first()[0]
    assert ks == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k) for k in range(1, 50)))


def test_exploration(spark):
    df = spark.createDataFrame([("b", 1.0, 1), ("a", 2.0, 2), ("b", 4.0, 3), (None, None, 4)], "c string, v double, id int")
    d = explore.describe_numeric(df, ["v"]).first()
    assert (d["count"], d["min"], d.q50, d["max"]) == (3, 1.0, 2.0, 4.0) and d.std == pytest.approx(np.std([1, 2, 4], ddof=1))
    c = explore.describe_categorical(df, ["c"]).first()
    assert (c["count"], c.unique, c.top, c.freq) == (3, 2, "b", 2)
    assert {r.value: r.code for r in explore.label_codes(df, ["c"]).collect()} == {"a": 0, "b": 1}
    assert {r.value: r.code for r in explore.first_seen_codes(df, ["c"], "id").collect()} == {"b": 0, "a": 1}
    hist = spark.createDataFrame([(0.0,), (0.04,), (1.0,), (0.99,), (None,)], "p double")
    assert {r.bin: r.n for r in explore.score_histogram(hist, "p").collect()} == {0: 1, 1: 1, 24: 2}
    coded = explore.encode(df, explore.label_codes(df, ["c"]), "c", "code")
    assert {(r.c, r.code) for r in coded.collect()} == {("a", 0), ("b", 1), (None, None)}


def test_chi_square_tail_with_many_degrees(spark):
    def exact(x, k):
        h = x / 2
        if k % 2 == 0:
            return sum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(k // 2))
        return math.erfc(math.sqrt(h)) + sum(math.exp(-h + (i - 0.5) * math.log(h) - math.lgamma(i + 0.5)) for i in range(1, (k - 1) // 2 + 1))

    cases = [(float(k * f), k) for k in (1, 2, 100, 199, 200, 201, 1499, 1500, 2000, 1_000_000) for f in (0.5, 0.97, 0.999, 1.0, 1.003, 1.05, 1.3, 3.0)]
    rows = with_chi_square_tail(spark.createDataFrame(cases, "x double, k bigint"), "x", "k", "p").collect()
    assert max(abs(r.p - exact(r.x, r.k)) for r in rows) < 1e-7


def test_chi_square_tail_of_the_sql():
    """The queries' SQL against the finite sum, also where its series for erf would not converge."""
    import duckdb

    for d, dof in ((529.07, 199), (150.0, 199), (140.0, 99), (300.0, 199), (79.9, 61), (80.1, 61), (3.0, 3), (250.0, 200), (1e4, 7)):
        h = d / 2
        if dof % 2 == 0:
            want = sum(math.exp(-h + i * math.log(h) - math.lgamma(i + 1)) for i in range(dof // 2))
        else:
            want = math.erfc(math.sqrt(h)) + sum(math.exp(-h + (i - 0.5) * math.log(h) - math.lgamma(i + 0.5)) for i in range(1, (dof - 1) // 2 + 1))
        got = duckdb.connect().execute(f"SELECT {CHI_TAIL} FROM (SELECT {d}::DOUBLE AS d, {dof}::BIGINT AS dof)").fetchone()[0]
        assert got == pytest.approx(want, abs=1e-9)


def test_missing_numbers_count_in_every_batch(spark):
    rows = spark.createDataFrame([(1, 1.0, "a"), (1, math.nan, "a"), (2, 1.0, "a")], "b int, x double, c string")
    known = quality.category_reference(rows, ["c"])
    got = {r.b: r.quality_status for r in quality.quality_by_batch(rows, known, ["c"], "b", ["x", "c"]).collect()}
    assert got == {1: "warning", 2: "ok"}
