"""Wide one-hot coding against the encoded columns, and exact KS p-values against counted paths."""

import math
from fractions import Fraction

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from holdfast.functions.stats import with_kolmogorov_exact
from holdfast.operators import features, wide


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, "hot" if i % 3 else f"id{i % 40}", "x y" if i % 2 else None, float(i % 5)) for i in range(400)]
    return spark.createDataFrame(rows, "id int, who string, `odd.kind` string, v double")


@pytest.mark.parametrize("narrow", [0, 100])
def test_slots_are_the_columns_of_the_narrow_form(spark, train, narrow):
    columns = ["who", "odd.kind"]
    dense = features.fit_one_hot(train, columns)
    model = wide.fit_wide(train, columns, narrow)
    names = [r["name"] for r in model.slot_names().orderBy("slot").collect()]
    assert names == dense.output_columns() and model.size() == len(names)
    assert set(model.narrow.levels) == (set(columns) if narrow == 100 else set())

    new = spark.createDataFrame([(1, "id3", "x y", None), (1, "id3", "x y", None), (2, None, None, 2.0), (3, "new", "?", 3.0), (4, "hot", "x y", 4.0)], train.schema)
    rows = new.unionByName(train)
    want = sorted((r["id"], r["v"] or 0.0, tuple(i for i, n in enumerate(names) if r[n])) for r in dense.transform(rows).collect())
    slots = wide.encode_slots(rows, model)
    assert slots.columns == ["id", "v", "slots"]
    assert sorted((r["id"], r["v"] or 0.0, tuple(r["slots"])) for r in slots.collect()) == want

    vectors = wide.encode_vectors(rows, model, ["v"])
    assert vectors.columns == [*rows.columns, "features"]
    found = [(r["id"], r["features"].toArray()) for r in vectors.collect()]
    assert sorted((i, x[0], tuple((x[1:].nonzero()[0]).tolist())) for i, x in found) == want
    assert {len(x) for _, x in found} == {1 + len(names)}


def test_wide_coding_of_little(spark, train):
    empty = wide.fit_wide(train.limit(0), ["who"])
    assert empty.size() == 0 and wide.encode_slots(train.limit(2), empty).first()["slots"] == []
    with pytest.raises(ValueError):
        wide.encode_vectors(train, empty)
    one_level = wide.fit_wide(train.where("who = 'hot'"), ["who"])
    assert one_level.size() == 0 and {tuple(r["slots"]) for r in wide.encode_slots(train, one_level).collect()} == {()}
    model = wide.fit_wide(train, ["who"], 0)
    assert wide.encode_slots(train.limit(0), model).collect() == []
    clash = train.withColumnRenamed("id", "slots")
    assert wide.encode_vectors(clash, model).count() == 400


def test_many_levels_reach_a_learner(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") % 2).alias("y"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("who"))
    model = wide.fit_wide(rows, ["who"])
    assert model.narrow.levels == {} and model.size() == n - math.ceil(n / 3)
    vectors = wide.encode_vectors(rows, model)
    first = vectors.where("who = 'u1'").first()["features"]
    # "hot" is the first level; "u1" the second.
    assert first.size == model.size() and first.indices.tolist() == [0]
    fitted = LogisticRegression(labelCol="y", maxIter=2).fit(vectors)
    assert fitted.coefficients.size == model.size() and fitted.coefficients[0] > 0


def _paths(n, m, gap):
    """Share of the orders of n and m values whose distance reaches gap / (n * m) somewhere."""
    inside = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if abs(i * m - j * n) < gap:
                inside[i][j] = 1 if i == j == 0 else (inside[i - 1][j] if i else 0) + (inside[i][j - 1] if j else 0)
    return 1 - Fraction(inside[n][m], math.comb(n + m, n))


def test_exact_ks_counts_paths(spark):
    cases = [(n, m, gap) for n, m in [(1, 1), (2, 3), (5, 5), (7, 4), (12, 30), (60, 60), (40, 150)] for gap in {1, n, m, n * m // 3, n * m // 2, n * m} if gap]
    rows = spark.createDataFrame([(i, g / (n * m), n, m) for i, (n, m, g) in enumerate(cases)], "i int, d double, n bigint, m bigint")
    got = {r["i"]: r["p"] for r in with_kolmogorov_exact(rows, "d", "n", "m", "p", 10_000).collect()}
    for i, case in enumerate(cases):
        assert got[i] == pytest.approx(float(_paths(*case)), rel=1e-9), case


def test_exact_ks_edges(spark):
    rows = spark.createDataFrame([(0.0, 5, 5), (0.5, 0, 5), (0.5, 101, 100), (None, 5, 5)], "d double, n bigint, m bigint")
    # A missing statistic says nothing about the samples.
    assert [r["p"] for r in with_kolmogorov_exact(rows, "d", "n", "m", "p", 10_000).collect()] == [1.0, None, None, None]
