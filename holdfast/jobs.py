"""The training lifecycle as plain jobs. Tables in a shared folder are the hand-over between them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import DecisionSettings, FeatureSettings, ModelSettings
from holdfast.functions.scalars import training_target
from holdfast.operators import rules
from holdfast.operators.decisions import customer_value, decide_batch
from holdfast.operators.drift import drift_report, drift_summary
from holdfast.operators.explain import explain_rows
from holdfast.operators.features import OneHotModel, build_features, fit_one_hot
from holdfast.operators.learning import coefficient_table, is_linear, score, train
from holdfast.operators.metrics import business_metrics, classification_metrics
from holdfast.operators.naming import feature_names, normalize_raw
from holdfast.operators.selection import stratified_split
from holdfast.operators.validation import TARGET, apply_contract, store_batches, stored_batches, validate_or_fail
from holdfast.sources import prediction_log
from holdfast.sources.snapshots import splits_from_manifest
from holdfast.sources.tables import append_history, path_exists, read_table

SEED = 42
TEST_SIZE = 0.2


def ingest_job(spark: SparkSession, base: DataFrame, batches: DataFrame | None, folder: str, batch: str = "batch_file") -> DataFrame:
    """Validated training table: the kept part of the base table and every accepted batch.

    A bad base row fails the job. Whether a customer is held out is decided once, when they first appear in the base table, and written to
    ``parts``; later runs split new customers only. So a base table that grows leaves every row in exactly one of ``holdout`` and ``validated``. Batches that
    were judged in an earlier run are not judged again; all accepted ones are part of the table, rejected ones stay in quarantine (``quarantined``).
    """
    run = uuid.uuid4().hex
    parts, stored = f"{folder}/parts", f"{folder}/batches"
    # Written before anything is joined to it: the planner moves filters of a join below the checks, which then meet rows they are not meant for.
    normalize_raw(validate_or_fail(normalize_raw(base))).write.mode("overwrite").parquet(f"{folder}/checked")
    checked = spark.read.parquet(f"{folder}/checked")
    new = checked
    if path_exists(spark, parts):
        new = checked.join(spark.read.parquet(parts).select("customerID"), "customerID", "left_anti")
    split = stratified_split(new, "customerID", TARGET, TEST_SIZE, SEED)
    split.select("customerID", "is_validation").write.parquet(f"{parts}/run={run}")
    decided = spark.read.parquet(parts).select("customerID", "is_validation")
    placed = checked.join(decided, "customerID").select(*checked.columns, "is_validation")
    placed.where("is_validation").drop("is_validation").write.mode("overwrite").parquet(f"{folder}/holdout")
    merged = placed.where("NOT is_validation").drop("is_validation")
    if batches is not None:
        fresh = normalize_raw(batches)
        if path_exists(spark, stored):
            known = spark.read.option("basePath", stored).parquet(f"{stored}/*").select(batch).distinct()
            fresh = fresh.join(known, batch, "left_anti").select(*fresh.columns)
        store_batches(apply_contract(fresh), batch, f"{stored}/run={run}")
    if path_exists(spark, stored):
        good = stored_batches(spark, f"{stored}/*", True).drop(batch, "run")
        merged = merged.unionByName(good, allowMissingColumns=True)
    merged.write.mode("overwrite").parquet(f"{folder}/validated")
    return spark.read.parquet(f"{folder}/validated")


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all rejected batches with the rules they break."""
    return stored_batches(spark, f"{folder}/batches/*", False).drop("run")


def feature_job(
    spark: SparkSession, validated: DataFrame, folder: str, settings: FeatureSettings = FeatureSettings(), keep_id: str | None = None
) -> tuple[DataFrame, OneHotModel]:
    """Features table and the fitted vocabulary, both stored. ``keep_id`` leaves one configured id column in."""
    vocabulary = fit_one_hot(feature_names(validated), settings.categorical_columns)
    drops = tuple(c for c in settings.drop_columns if c != keep_id)
    steps = FeatureSettings(settings.enabled_steps, settings.cast_to_numeric, settings.numeric_columns, settings.categorical_columns, drops)
    features = build_features(validated, steps, vocabulary)
    features.write.mode("overwrite").parquet(f"{folder}/features")
    line = spark.range(0, 1, 1, 1).select(F.lit(vocabulary.to_json()).alias("value"))
    line.write.mode("overwrite").text(f"{folder}/vocabulary")
    return spark.read.parquet(f"{folder}/features"), vocabulary


def split_job(
    spark: SparkSession, rows: DataFrame, folder: str, identity: str, stratum: str, test_size: float = TEST_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Stratified training and validation tables."""
    split = stratified_split(rows, identity, stratum, test_size, seed)
    split.write.mode("overwrite").partitionBy("is_validation").parquet(folder)
    return spark.read.parquet(f"{folder}/is_validation=false"), spark.read.parquet(f"{folder}/is_validation=true")


def training_job(
    train_rows: DataFrame, validation: DataFrame, folder: str, features: Sequence[str], target: str = "churn", s: ModelSettings = ModelSettings()
) -> tuple[PipelineModel, DataFrame]:
    """Fit, tune and validate; store the model and append the run row."""
    labeled = [df.withColumn("_y", training_target(F.col(target))) for df in (train_rows, validation)]
    model, run = train(*labeled, features, "_y", s)
    run_id = run.first().run_id
    model.write().overwrite().save(f"{folder}/models/{run_id}")
    if is_linear(model):
        coefficient_table(model, features, train_rows).write.mode("overwrite").parquet(f"{folder}/coefficients/{run_id}")
    run.write.mode("append").parquet(f"{folder}/runs")
    return model, run


def rerun_job(spark: SparkSession, manifest: dict, folder: str, features: Sequence[str], target: str = "churn", s: ModelSettings | None = None) -> tuple[PipelineModel, DataFrame]:
    """Train again from the splits that a manifest names, with the model settings of its ``effective_config`` unless others are given."""
    if s is None:
        s = ModelSettings(**json.loads(manifest.get("effective_config") or "{}").get("model", {}))
    return training_job(*splits_from_manifest(spark, manifest), folder, features, target, s)


def explain_job(
    spark: SparkSession, folder: str, run_id: str, encoded: DataFrame, identity: str, vocabulary: OneHotModel | None = None, top_n: int = 5
) -> DataFrame:
    """Top reasons of encoded rows under a stored linear model, by source column; the vocabulary is read from the folder unless it is given."""
    weights = spark.read.parquet(f"{folder}/coefficients/{run_id}")
    vocabulary = vocabulary or read_vocabulary(spark, folder)
    return explain_rows(encoded, identity, weights, vocabulary.source_of(), top_n)


def read_vocabulary(spark: SparkSession, folder: str) -> OneHotModel:
    """The vocabulary that :func:`feature_job` stored."""
    return OneHotModel.from_json(spark.read.text(f"{folder}/vocabulary", wholetext=True).first().value)


def evaluate_batch(
    spark: SparkSession,
    path: str,
    history: str | None = None,
    y_true: str = "Churn",
    y_score: str = "churn_probability",
    action: str | None = "action",
    threshold: float = 0.5,
    s: DecisionSettings = DecisionSettings(),
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Metric row of a labeled batch file, with business fields when it has actions; appended to a history if one is named."""
    batch = read_table(spark, path, schema=schema)
    row = classification_metrics(batch, y_true, y_score, threshold)
    if action and action in batch.columns:
        money = business_metrics(batch, y_true, y_score, action, settings=s)
        money = money.select(*[F.col(c).alias(f"business_{c}") for c in money.columns])
        row = row.join(F.broadcast(money))
    row = row.withColumnRenamed("f1", "f1_score")
    return append_history(row, history) if history else row


def drift_job(
    reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str], history: str, at: Column | None = None
) -> bool:
    """Test all features both tables have, append the long result to ``history``, and say whether any has drifted."""
    stored = append_history(drift_report(reference, current, numeric, categorical), history, at=at)
    return bool(drift_summary(stored).first().drift_detected)


def scoring_job(
    spark: SparkSession,
    raw: DataFrame,
    vocabulary: OneHotModel,
    scorer: Callable[[DataFrame], DataFrame],
    log: str,
    request_id: str,
    settings: FeatureSettings = FeatureSettings(),
    decisions: DecisionSettings = DecisionSettings(),
    at: Column | None = None,
) -> DataFrame:
    """Score a batch of raw customers: names, features, score, value, decision, log. Returns the logged rows of the request.

    ``scorer`` adds ``churn_probability`` to encoded rows, such as :func:`learning.score` with a fitted model. The logged inputs are the raw ones.
    """
    named = feature_names(normalize_raw(raw))
    drops = tuple(c for c in settings.drop_columns if c != "customerid")
    encoded = build_features(named, FeatureSettings(settings.enabled_steps, settings.cast_to_numeric, settings.numeric_columns, settings.categorical_columns, drops), vocabulary)
    scored = named.join(scorer(encoded).select("customerid", "churn_probability"), "customerid")
    worth = customer_value(scored, decisions.customer_value, "monthlycharges", "tenure")
    decided = decide_batch(scored.withColumn("customer_value", worth), "customerid", "churn_probability", s=decisions)
    prediction_log.append(prediction_log.enrich(decided, request_id=request_id, at=at), log)
    return prediction_log.read_request(spark, log, request_id)


def register(spark: SparkSession, folder: str, run_id: str, alias: str, at: Column | None = None) -> None:
    """Give a run an alias; the newest assignment counts."""
    if alias not in ("champion", "challenger"):
        raise ValueError(f"An alias is champion or challenger, not {alias!r}.")
    moment = at if at is not None else F.current_timestamp()
    row = spark.range(0, 1, 1, 1).select(F.lit(alias).alias("alias"), F.lit(run_id).alias("run_id"), moment.alias("assigned_at"))
    row.write.mode("append").parquet(f"{folder}/aliases")


def promote_job(spark: SparkSession, validation: DataFrame, folder: str, run_id: str, features: Sequence[str], target: str = "churn") -> bool:
    """Compare a run with the champion on the validation rows, each at its own threshold, and register it."""
    runs = spark.read.parquet(f"{folder}/runs")
    thresholds = {r.run_id: r.decision_threshold for r in runs.select("run_id", "decision_threshold").where(F.col("run_id") == run_id).collect()}
    scored = validation.withColumn("_y", training_target(F.col(target)))
    scored = score(PipelineModel.load(f"{folder}/models/{run_id}"), scored, features, "_challenger")
    scores = {"challenger": ("_challenger", thresholds[run_id])}
    if path_exists(spark, f"{folder}/aliases"):
        current = rules.latest_aliases(spark.read.parquet(f"{folder}/aliases")).where("alias = 'champion'").join(runs, "run_id").first()
        if current is not None:
            scored = score(PipelineModel.load(f"{folder}/models/{current.run_id}"), scored, features, "_champion")
            scores["champion"] = ("_champion", current.decision_threshold)
    better = rules.compare_models(scored, "_y", scores).first().is_better
    register(spark, folder, run_id, "champion" if better else "challenger")
    return better
