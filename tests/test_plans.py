"""Physical plans: what must be pushed down, shared, kept out."""

import re

import pytest
from pyspark.sql import functions as F

from holdfast.operators import drift, metrics
from holdfast.operators.joins import join_unique
from holdfast.plans import bindings as B
from holdfast.plans import catalog

SF = "/root/testdata/sf0.001"
RUNS_JOBS = ("gbt_scores", "soft_vote", "train_run")


def plan_of(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream_") and n not in RUNS_JOBS))
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert not re.search(r"(ArrowEval|BatchEval|MapIn|FlatMapGroupsIn)P", plan)


def _final(plan):
    return plan.split("== Initial Plan ==")[0]


def test_a_full_report_shuffles_its_scores_once(spark):
    rows = spark.range(5000).select((F.rand(1) * 100).cast("int").alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    rows = rows.withColumn("s", F.col("s") / 100.0)
    df = metrics.classification_metrics(rows, "y", "s", numeric_target=True)
    final = _final(plan_of(df, run=True))
    assert final.count("Range") == 1 and final.count("ReusedExchange") >= 3


def test_drift_reads_each_side_once(spark):
    li = B.table(spark, SF, "lineitem")
    cut = F.col("l_linenumber") <= 2
    names = ["l_quantity", "l_discount"]
    df = drift.numeric_drift(drift.both_sides(li.where(cut), li.where(~cut), names), names)
    final = _final(plan_of(df, run=True))
    assert len(re.findall(r"FileScan", final)) == 2
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_discount:double>" in final


def test_pushdown_reaches_the_files(spark):
    plan = plan_of(B.table(spark, SF, "orders").where("o_orderkey = 7").select("o_custkey"))
    assert "EqualTo(o_orderkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_hot_key_is_spread_over_tasks(spark):
    # A third of the rows share one key.
    left = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"))
    right = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    old = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = join_unique(left, right, "k")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in left.join(right, "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert sum(sizes) == sum(plain) == 60_000
    assert max(plain) > 20_000 > 3 * 60_000 / 16 > max(sizes)


def test_keys_of_half_and_of_three_hundredths_are_split_by_their_size(spark):
    k = F.when(F.col("id") % 2 == 0, F.lit(-1)).when(F.col("id") % 33 == 0, F.lit(-2)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id"))
    left = spark.range(60_000).select("id", k.alias("k"))
    right = spark.range(-2, 60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    old = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = join_unique(left, right, "k", "left")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        same = joined.where("v = 2 * k OR (k IS NULL AND v IS NULL)").count()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert sum(sizes) == same == 60_000
    assert max(sizes) < 3 * 60_000 / 32
