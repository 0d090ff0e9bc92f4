import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators.joins import join_unique
from holdfast.operators.ordering import collapse, exact_quantiles, running_totals
from holdfast.operators.selection import seeded_sample, stratified_split, top_flag


@pytest.mark.parametrize("shape", ["distinct", "ties", "one_hot_value"])
def test_running_totals_equal_a_sorted_cumsum(spark, shape):
    rng = np.random.default_rng(1)
    n = 5000
    keys = {"distinct": rng.normal(size=n), "ties": rng.integers(0, 40, n) / 7.0, "one_hot_value": np.where(rng.random(n) < 0.4, 0.5, rng.random(n))}[shape]
    pdf = pd.DataFrame({"k": keys, "w": rng.integers(0, 3, n)})
    got = running_totals(collapse(spark.createDataFrame(pdf), "k", {"w": F.col("w")}), "k", ["w"], buckets=16).toPandas().sort_values("k")
    want = pdf.groupby("k").w.sum()
    want = want[want > 0]
    assert np.allclose(got.k, want.index)
    assert (got.cum_w.to_numpy() == want.cumsum().to_numpy()).all()
    assert (got.all_w == want.sum()).all()


def test_running_totals_by_group_with_uneven_groups(spark):
    rng = np.random.default_rng(2)
    groups = np.concatenate([np.zeros(4000, int), rng.integers(1, 300, 2000)])
    pdf = pd.DataFrame({"g": groups, "k": rng.normal(size=6000)})
    got = running_totals(collapse(spark.createDataFrame(pdf), "k", {"n": F.lit(1)}, ["g"]), "k", ["n"], ["g"], buckets=32).toPandas()
    pdf["rank"] = pdf.groupby("g").k.rank().astype(int)
    merged = got.merge(pdf, on=["g", "k"])
    assert len(merged) == 6000
    assert (merged.cum_n == merged["rank"]).all()


def test_text_keys_are_ordered_too(spark):
    words = [f"w{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = running_totals(collapse(df, "w", {"n": F.lit(1)}), "w", ["n"], buckets=16).toPandas().sort_values("w")
    assert got.cum_n.tolist() == list(range(1, 501))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 1001 + ["b"] * 20 + ["c"], "v": np.concatenate([rng.normal(size=1001), np.arange(20.0), [7.0]])})
    df = spark.createDataFrame(pdf)
    linear = exact_quantiles(df, "v", [0.25, 0.5, 0.99], ["g"]).toPandas()
    nearest = exact_quantiles(df, "v", [0.5, 0.95, 0.99], ["g"], nearest=True).toPandas()
    for r in linear.itertuples():
        assert r.quantile == pytest.approx(np.quantile(pdf.v[pdf.g == r.g], r.probability))
    for r in nearest.itertuples():
        values = np.sort(pdf.v[pdf.g == r.g])
        assert r.quantile == values[round((len(values) - 1) * r.probability)]
    assert len(linear) == 9 and len(nearest) == 9


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join_equals_a_plain_join(spark, how):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id")
    left = left.union(spark.createDataFrame([(None, -1)], "k bigint, id bigint"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = sorted(map(tuple, join_unique(left, right, "k", how).select("id", "k", "v").collect()), key=str)
    want = sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()), key=str)
    assert got == want


@pytest.mark.parametrize("limit", [{"k": 0}, {"k": 5}, {"k": 37}, {"share": 0.2}, {"share": 0.0}, {"share": 1.0}, {"k": 10_500}])
def test_top_flag_matches_a_sort(spark, limit):
    rng = np.random.default_rng(4)
    n = 12_000 if limit.get("k", 0) > 10_000 else 400
    pdf = pd.DataFrame({"id": np.arange(n), "v": rng.integers(-3, 12, n) / 2.0})
    marked = top_flag(spark.createDataFrame(pdf), "v", "id", "top", **limit).toPandas()
    k = limit["k"] if "k" in limit else int(n * limit["share"])
    ordered = pdf.sort_values(["v", "id"], ascending=[False, True]).head(k)
    assert set(marked.id[marked.top]) == set(ordered.id[ordered.v > 0])
    assert len(marked) == n


def test_stratified_split_has_exact_shares(spark):
    rows = [(f"c{i}", "Yes" if i % 10 < 3 else "No") for i in range(1003)]
    df = spark.createDataFrame(rows, "id string, churn string")
    split = stratified_split(df, "id", "churn", 0.2, 42)
    counts = {r.churn: r.n for r in split.where("is_validation").groupBy("churn").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 201
    assert counts["Yes"] in (60, 61)
    again = stratified_split(df.repartition(7), "id", "churn", 0.2, 42)
    assert again.exceptAll(split).isEmpty()
    other = stratified_split(df, "id", "churn", 0.2, 43)
    assert not other.exceptAll(split).isEmpty()


def test_seeded_sample_is_stable(spark):
    df = spark.range(500)
    a = {r.id for r in seeded_sample(df, "id", 50).collect()}
    assert a == {r.id for r in seeded_sample(df.repartition(9), "id", 50).collect()}
    assert len(a) == 50


@pytest.mark.parametrize("limit", [{"k": 1}, {"k": 4}, {"k": 9}, {"k": 30}, {"share": 0.5}, {"k": 0}])
@pytest.mark.parametrize("positive_only", [True, False])
def test_a_cut_among_values_of_any_size(spark, limit, positive_only):
    """Huge, tiny, negative, infinite, missing and equal values: the cells keep their order."""
    values = [float("inf"), 1e300, 5.0, 5.0, 5.0, 4.999999, 1e-300, 5e-324, 0.0, -0.0, -1e-300, -5.0, -5.0, -1e300, float("-inf"), None, float("nan"), 2.0, 3.0, 1.0]
    rows = [(i, v) for i, v in enumerate(values)]
    marked = {r.id for r in top_flag(spark.createDataFrame(rows, "id int, v double"), "v", "id", "top", positive_only=positive_only, **limit).where("top").collect()}
    ranked = sorted((-v, i) for i, v in rows if v is not None and v == v)
    n = limit["k"] if "k" in limit else int(len(rows) * limit["share"])
    assert marked == {i for v, i in ranked[:n] if -v > 0 or not positive_only}
