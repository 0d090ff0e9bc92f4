"""Ingest, features, split, training and promotion over one folder."""

import pytest
from pyspark.sql import functions as F

from holdfast import jobs
from holdfast.config import ModelSettings
from holdfast.operators import naming
from holdfast.operators.features import OneHotModel
from holdfast.sources import prediction_log
from holdfast.sources.tables import read_history
from test_tables import customers


def _base(spark, n=60):
    rows = [{"customerID": f"c{i}", "tenure": str(i % 30), "Churn": "Yes" if i % 30 < 10 else "No", "gender": "Male" if i % 2 else "Female"} for i in range(n)]
    return customers(spark, *rows)


def test_lifecycle(spark, tmp_path):
    folder = str(tmp_path)
    batches = customers(spark, {"customerID": "n1"}, {"customerID": "n2", "tenure": "-1"}, {"customerID": "n3"})
    batches = batches.withColumn("batch_file", F.when(F.col("customerID") == "n1", "a").otherwise("b"))
    validated = jobs.ingest_job(spark, _base(spark), batches, folder)
    assert validated.count() == 48 + 1
    assert jobs.quarantined(spark, folder).count() == 2
    held = spark.read.parquet(f"{folder}/holdout")
    assert held.count() == 12 and held.join(validated, "customerID").count() == 0
    again = jobs.ingest_job(spark, _base(spark), batches, folder)
    assert again.count() == 48 + 1 and jobs.quarantined(spark, folder).count() == 2

    features, vocabulary = jobs.feature_job(spark, spark.read.parquet(f"{folder}/validated"), folder, keep_id="customerid")
    assert "gender_Male" in features.columns and "customerid" in features.columns
    assert OneHotModel.from_json(spark.read.text(f"{folder}/vocabulary").first().value) == vocabulary

    train, validation = jobs.split_job(spark, features, f"{folder}/splits", "customerid", "churn")
    assert train.count() + validation.count() == 49
    names = ["tenure", "monthlycharges", "gender_Male"]
    quick = ModelSettings(kind="logistic_regression")
    _, run = jobs.training_job(train, validation, folder, names, s=quick)
    assert jobs.promote_job(spark, validation, folder, run.first().run_id, names) is True
    _, again = jobs.training_job(train, validation, folder, names, s=quick)
    assert jobs.promote_job(spark, validation, folder, again.first().run_id, names) is False
    aliases = {r.alias: r.run_id for r in spark.read.parquet(f"{folder}/aliases").collect()}
    assert aliases == {"champion": run.first().run_id, "challenger": again.first().run_id}
    with pytest.raises(ValueError):
        jobs.register(spark, folder, "x", "other")


def test_scoring_job_logs_the_raw_inputs(spark, tmp_path):
    folder = str(tmp_path)
    raw = _base(spark, 20).drop("Churn")
    _, vocabulary = jobs.feature_job(spark, naming.feature_names(naming.normalize_raw(_base(spark))), folder, keep_id="customerid")

    def scorer(encoded):
        assert "gender_Male" in encoded.columns
        return encoded.withColumn("churn_probability", F.col("tenure").cast("double") / 20)

    logged = jobs.scoring_job(spark, raw, vocabulary, scorer, f"{folder}/log", "r1", at=F.lit("2024-01-01").cast("timestamp"))
    rows = {r.customerid: r for r in logged.collect()}
    assert len(rows) == 20 and len({r.prediction_id for r in rows.values()}) == 20
    assert rows["c5"].churn_probability == 0.25 and rows["c5"].tenure == "5" and rows["c5"].customer_value > 0
    assert {r.action for r in rows.values()} <= {"no_action", "send_email", "offer_discount"}
    assert prediction_log.check_request(logged, 20) is None


def test_drift_job_keeps_its_history(spark, tmp_path):
    a = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), F.lit("k").alias("c"))
    b = a.withColumn("x", F.col("x") + 10)
    history = f"{tmp_path}/history"
    assert jobs.drift_job(a, b, ["x"], ["c"], history) is True
    assert jobs.drift_job(a, a, ["x"], ["c"], history) is False
    assert read_history(spark, history).count() == 4


def test_a_growing_base_loses_no_row(spark, tmp_path):
    folder = str(tmp_path)
    first = jobs.ingest_job(spark, _base(spark), None, folder).count()
    held = {r.customerID for r in spark.read.parquet(f"{folder}/holdout").collect()}
    train = {r.customerID for r in jobs.ingest_job(spark, _base(spark, 300), None, folder).collect()}
    later = {r.customerID for r in spark.read.parquet(f"{folder}/holdout").collect()}
    assert first == 48 and len(held) == 12 and held < later
    assert train | later == {f"c{i}" for i in range(300)} and not train & later and len(later) == 60


def test_bad_base_row_stops_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="Validation failed"):
        jobs.ingest_job(spark, customers(spark, {"gender": "Other"}, {}), None, str(tmp_path))
