"""Model jobs on Spark ML: fit, score, tune the threshold, keep run and alias rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import CostSettings, ModelSettings
from holdfast.operators.metrics import best_threshold, classification_metrics, labeled_rows


# Names of the columns that models read and write. None of them is a name of the input.
_LABEL, _FEATURES = "_label", "_features"


def _number(name: str) -> str:
    return f"_number_{name}"


def _number_of(name: str) -> Column:
    return F.col(f"`{_number(name)}`")


def build_model(s: ModelSettings, label: str = _LABEL, features: str = _FEATURES):
    """Estimator by kind; an unknown kind is an error."""
    names = {"labelCol": label, "featuresCol": features, **s.extra}
    if s.kind == "logistic_irls":
        # Its prediction is the probability itself. Newton steps from sums over all rows: the same coefficients on every run, to the last digits.
        return GeneralizedLinearRegression(**{"family": "binomial", "link": "logit", "tol": 1e-12, "maxIter": 50, **names}).setPredictionCol("_probability")
    estimator = _estimator(s, names)
    return estimator.setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw")


def _estimator(s: ModelSettings, names: dict):
    if s.kind == "gradient_boosting":
        return GBTClassifier(maxIter=s.n_estimators, maxDepth=s.max_depth, stepSize=s.learning_rate, seed=s.seed, **names)
    if s.kind == "random_forest":
        return RandomForestClassifier(numTrees=s.n_estimators, maxDepth=s.max_depth, seed=s.seed, **names)
    if s.kind == "logistic_regression":
        return LogisticRegression(**names)
    if s.kind == "decision_tree":
        return DecisionTreeClassifier(maxDepth=s.max_depth, seed=s.seed, **names)
    raise ValueError(f"No estimator is known for kind {s.kind!r}.")


def _prepared(df: DataFrame, features: Sequence[str], target: str | None) -> DataFrame:
    """``df`` with the features as numbers beside it, missing ones as 0."""
    df = df.withColumns({_number(c): F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features})
    return df.withColumn(_LABEL, F.col(target).cast("double")) if target else df


def fit(train: DataFrame, features: Sequence[str], target: str, s: ModelSettings = ModelSettings()) -> PipelineModel:
    """Assemble and fit. ``target`` holds 0 and 1."""
    stages = [VectorAssembler(inputCols=[_number(c) for c in features], outputCol=_FEATURES), build_model(s)]
    return Pipeline(stages=stages).fit(_prepared(train, features, target))


def probability_of_one(column: str = "_probability") -> Column:
    return F.get(vector_to_array(F.col(column)), 1)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], output: str = "churn_probability") -> DataFrame:
    """Input columns, unchanged, plus the probability of class 1. Scoring is a map over rows: no shuffle."""
    scored = model.transform(_prepared(df, features, None))
    plain = dict(scored.dtypes)["_probability"] == "double"
    return scored.withColumn(output, F.col("_probability") if plain else probability_of_one()).select(*[F.col(f"`{c}`") for c in df.columns if c != output], output)


def score_with(
    df: DataFrame, load: Callable[[], Callable], features: Sequence[str], output: str = "churn_probability"
) -> DataFrame:
    """Score with a model Spark does not know: ``load`` gives a function of a pandas frame, once per task.

    The only place where rows pass through Python, in Arrow batches.
    """
    names = list(features)

    def run(batches):
        predict = load()
        for pdf in batches:
            pdf[output] = np.asarray(predict(pdf[names]), dtype=float)
            yield pdf

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])
    return df.mapInPandas(run, schema)


def soft_vote(df: DataFrame, models: Sequence[PipelineModel], features: Sequence[str], output: str = "churn_probability") -> DataFrame:
    """Mean of the models' probabilities."""
    names = [f"_p{i}" for i in range(len(models))]
    columns = df.columns
    for name, model in zip(names, models, strict=True):
        df = score(model, df, features, name)
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(name)
    return df.select(*columns, (total / len(names)).alias(output))


def train(
    train_rows: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    target: str,
    s: ModelSettings = ModelSettings(),
    started_at: Column | None = None,
    costs: CostSettings = CostSettings(),
) -> tuple[PipelineModel, DataFrame]:
    """Fit, tune the threshold on the validation part, and return the model with its one-row run record."""
    import time

    spark = train_rows.sparkSession
    began = time.perf_counter()
    model = fit(train_rows, features, target, s)
    seconds = time.perf_counter() - began
    # Two readers: the threshold search and the metrics at the threshold found.
    scored = score(model, validation, features).select(target, "churn_probability").persist(StorageLevel.DISK_ONLY)
    labeled = labeled_rows(scored, target, "churn_probability", numeric_target=True)
    chosen = best_threshold(labeled).first()
    metrics = classification_metrics(scored, target, "churn_probability", chosen.best_threshold, numeric_target=True)
    names = ("accuracy", "precision", "recall", "f1", "roc_auc", "brier_score")
    packed = F.create_map(*[part for n in names for part in (F.lit(n), F.col(n))])
    run = metrics.select(
        F.lit(uuid.uuid4().hex).alias("run_id"),
        (started_at if started_at is not None else F.current_timestamp()).alias("start_time"),
        F.lit(s.kind).alias("model_type"),
        F.lit(chosen.best_threshold).alias("decision_threshold"),
        F.lit(len(features)).alias("n_features"),
        packed.alias("metrics"),
        F.lit(round(seconds, 3)).alias("training_duration_seconds"),
        F.lit(round(seconds / 3600.0 * costs.estimated_hourly_rate if costs.enabled else 0.0, 6)).alias("estimated_training_cost"),
        F.lit(costs.currency).alias("cost_currency"),
    )
    rows = run.collect()
    scored.unpersist()
    return model, spark.createDataFrame(rows, run.schema)


def is_linear(model: PipelineModel) -> bool:
    return hasattr(model.stages[-1], "coefficients")


def linear_coefficients(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Coefficient of each feature of a fitted logistic model."""
    return dict(zip(features, [float(v) for v in model.stages[-1].coefficients], strict=True))


def coefficient_table(model: PipelineModel, features: Sequence[str], background: DataFrame) -> DataFrame:
    """feature, coefficient, mean: what explaining a row of a linear model needs, one row per column of the encoded table.

    The mean is that of ``background``, the rows that the model was fitted on, so explanations later need no look at them.
    """
    prepared = _prepared(background, features, None)
    means = prepared.agg(*[F.avg(_number_of(c)).alias(f"_m{i}") for i, c in enumerate(features)]).first()
    weights = linear_coefficients(model, features)
    rows = [(c, weights[c], float(means[i] or 0.0)) for i, c in enumerate(features)]
    return background.sparkSession.createDataFrame(rows, "feature string, coefficient double, mean double")
