"""What was in force at a moment."""

import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators.asof import asof_join, with_marks


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_asof_join_matches_brute_force(spark, buckets):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(100)])) for i in range(400)]
    rows += [(1000 + i, "hot", 50) for i in range(200)]  # one instant, many rows
    changes = [(rng.choice(["hot", "b", "c", None]), rng.choice([None, *range(0, 100, 3)]), rng.randint(0, 5), rng.choice([None, "x", "y"])) for _ in range(80)]
    left = spark.createDataFrame(rows, "id int, k string, at int")
    right = spark.createDataFrame(changes, "k string, since int, seq int, v string")
    got = asof_join(left, right, "at", "since", ["k"], ["seq", "v"], buckets=buckets)
    assert got.columns == ["id", "k", "at", "since", "seq", "v"]
    want = []
    for i, k, at in rows:
        held = [(s, q, v is not None, v or "") for c, s, q, v in changes if k is not None and c == k and s is not None and at is not None and s <= at]
        s, q, some, v = max(held) if held else (None, None, None, None)
        want.append((i, k, at, s, q, v if some else None))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_asof_join_without_keys_and_without_changes(spark):
    left = spark.createDataFrame([(1, 5), (2, None)], "id int, at int")
    none = spark.createDataFrame([], "since int, v int")
    assert sorted((r.id, r.v) for r in asof_join(left, none, "at", "since", values=["v"]).collect()) == [(1, None), (2, None)]
    assert asof_join(left.limit(0), none, "at", "since", values=["v"]).collect() == []
    with pytest.raises(ValueError):
        asof_join(left, none.withColumnRenamed("v", "id"), "at", "since", values=["id"])


def test_a_hot_key_is_spread_over_buckets(spark):
    """All rows have one key: the rows are spread over the tasks of the window by time."""
    left = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    right = spark.range(0, 4000, 10).select(F.lit("k").alias("k"), F.col("id").alias("since"), (F.col("id") * 2).alias("v"))
    got = asof_join(left, right, "at", "since", ["k"], ["v"], buckets=16)
    assert got.where("since <> at - at % 10 OR v <> since * 2 OR since IS NULL").count() == 0


def test_marks(spark):
    rows = spark.createDataFrame([(1, True, False), (2, False, None), (3, True, True), (4, False, False)], "at int, a boolean, b boolean")
    got = {r["at"]: (r.last_a, r.last_b) for r in with_marks(rows, "at", ["a", "b"]).collect()}
    assert got == {1: (1, None), 2: (1, None), 3: (3, 3), 4: (3, 3)}
