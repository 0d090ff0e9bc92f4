"""Schema contract of raw customers: coercion, domain rules, reports and whole-batch quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.scalars import drop_nan
from holdfast.operators.joins import join_unique


@dataclass(frozen=True)
class FieldRule:
    """Type, domain and nullability of one column."""

    name: str
    dtype: str
    allowed: tuple | None = None
    minimum: float | None = None
    nullable: bool = False
    required: bool = True


_YES_NO = ("Yes", "No")
# The raw customer contract, in column order.
CUSTOMER_CONTRACT = (
    FieldRule("customerID", "string"),
    FieldRule("gender", "string", ("Female", "Male")),
    FieldRule("SeniorCitizen", "bigint", (0, 1)),
    FieldRule("Partner", "string", _YES_NO),
    FieldRule("Dependents", "string", _YES_NO),
    FieldRule("tenure", "bigint", minimum=0),
    FieldRule("PhoneService", "string", _YES_NO),
    FieldRule("MultipleLines", "string", ("Yes", "No", "No phone service")),
    FieldRule("InternetService", "string", ("DSL", "Fiber optic", "No")),
    FieldRule("OnlineSecurity", "string", nullable=True),
    FieldRule("OnlineBackup", "string", nullable=True),
    FieldRule("DeviceProtection", "string", nullable=True),
    FieldRule("TechSupport", "string", nullable=True),
    FieldRule("StreamingTV", "string", nullable=True),
    FieldRule("StreamingMovies", "string", nullable=True),
    FieldRule("Contract", "string", ("Month-to-month", "One year", "Two year")),
    FieldRule("PaperlessBilling", "string", _YES_NO),
    FieldRule("PaymentMethod", "string", nullable=True),
    FieldRule("MonthlyCharges", "double", minimum=0),
    FieldRule("TotalCharges", "string", nullable=True, required=False),
    FieldRule("Churn", "string", _YES_NO, nullable=True, required=False),
)
TARGET = "Churn"
RAW_COLUMNS = tuple(rule.name for rule in CUSTOMER_CONTRACT)


def inference_contract(contract: Sequence[FieldRule] = CUSTOMER_CONTRACT) -> tuple[FieldRule, ...]:
    """The contract without the target."""
    return tuple(rule for rule in contract if rule.name != TARGET)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"The table lacks the columns {missing}.")


def _coerced(rule: FieldRule, dtype: T.DataType) -> Column:
    raw = F.col(f"`{rule.name}`")
    if rule.dtype == "string":
        return raw.cast("string")
    if isinstance(dtype, T.IntegralType) and rule.dtype == "bigint":
        return raw.cast("bigint")
    number = drop_nan(raw.cast("double") if isinstance(dtype, T.NumericType) else raw.cast("string").try_cast("double"))
    if rule.dtype == "bigint":
        # A whole-number column takes no fractions.
        return F.when(number == F.floor(number), number.cast("bigint"))
    return number


def _failures(rule: FieldRule) -> list[tuple[Column, str]]:
    """(failed?, rule name) of one column, on raw column ``<name>`` and coerced column ``_c_<name>``."""
    raw, value = F.col(f"`{rule.name}`"), F.col(f"`_c_{rule.name}`")
    found = [(raw.isNotNull() & value.isNull(), f"{rule.name}:type")]
    if not rule.nullable:
        found.append((raw.isNull(), f"{rule.name}:null"))
    if rule.allowed is not None:
        found.append((value.isNotNull() & ~value.isin(*rule.allowed), f"{rule.name}:domain"))
    if rule.minimum is not None:
        found.append((value.isNotNull() & (value < rule.minimum), f"{rule.name}:minimum"))
    return found


def apply_contract(df: DataFrame, contract: Sequence[FieldRule] = CUSTOMER_CONTRACT, failed: str = "failed_rules") -> DataFrame:
    """Coerce the contract's columns, keep extra ones, and add the array of failed rule names per row."""
    require_columns(df, [rule.name for rule in contract if rule.required])
    present = [rule for rule in contract if rule.name in df.columns]
    names = {rule.name for rule in present}
    coerced = df.select("*", *[_coerced(rule, df.schema[rule.name].dataType).alias(f"_c_{rule.name}") for rule in present])
    checks = [F.when(bad, F.lit(name)) for rule in present for bad, name in _failures(rule)]
    return coerced.select(
        *[F.col(f"`_c_{n}`").alias(n) if n in names else F.col(f"`{n}`") for n in df.columns],
        F.array_compact(F.array(*checks)).alias(failed),
    )


def require_rows(df: DataFrame, message: str = "There is no row to score.") -> DataFrame:
    """Fail on an empty frame. Looks at one row only."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def validate_or_fail(df: DataFrame, contract: Sequence[FieldRule] = CUSTOMER_CONTRACT) -> DataFrame:
    """Coerced frame; the job fails on a value that breaks a rule.

    Each column carries its own check, so a column is checked wherever it is read, and all of them when the frame
    is written. One filter over all rules would do the same, but the planner derives a constraint from it for every
    combination of coerced columns, which grows without bound.
    """
    require_columns(df, [rule.name for rule in contract if rule.required])
    rules = {rule.name: rule for rule in contract if rule.name in df.columns}
    coerced = df.select("*", *[_coerced(r, df.schema[n].dataType).alias(f"_c_{n}") for n, r in rules.items()])

    def checked(name: str) -> Column:
        if name not in rules:
            return F.col(f"`{name}`")
        value = F.col(f"`_c_{name}`")
        outcome = None
        for bad, text in _failures(rules[name]):
            problem = F.raise_error(F.lit(f"Validation failed: {text}")).cast(rules[name].dtype)
            outcome = F.when(bad, problem) if outcome is None else outcome.when(bad, problem)
        return outcome.otherwise(value).alias(name)

    return coerced.select(*[checked(n) for n in df.columns])


def validation_report(checked: DataFrame, failed: str = "failed_rules") -> DataFrame:
    """Rows that fail, by rule."""
    return checked.select(F.explode(failed).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows_failed"))


def batch_verdicts(checked: DataFrame, batch: str, failed: str = "failed_rules") -> DataFrame:
    """One row per batch: rows, bad rows and whether the whole batch is accepted."""
    bad = F.count_if(F.size(failed) > 0)
    return checked.groupBy(batch).agg(
        F.count("*").alias("n_rows"), bad.alias("n_bad"), (bad == 0).alias("accepted")
    )


def judge_batches(checked: DataFrame, batch: str, failed: str = "failed_rules") -> DataFrame:
    """Rows with ``accepted``: one bad row rejects its whole batch. A batch may hold any share of the rows."""
    verdicts = batch_verdicts(checked, batch, failed)
    counts = verdicts.select(batch, F.col("n_rows").alias("_rows"))
    return join_unique(checked, verdicts.select(batch, "accepted"), batch, counts=counts)


def split_batches(checked: DataFrame, batch: str, failed: str = "failed_rules") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows)."""
    judged = judge_batches(checked, batch, failed)
    columns = checked.columns
    return judged.where("accepted").select(*columns), judged.where("NOT accepted").select(*columns)


def store_batches(checked: DataFrame, batch: str, folder: str, failed: str = "failed_rules", replace: bool = False) -> None:
    """Write judged rows in one pass, with accepted and quarantined rows in folders of their own under ``folder``.

    A folder that holds rows already is an error, unless it is to be replaced (a micro-batch that is run again).
    """
    judged = judge_batches(checked, batch, failed)
    judged.write.mode("overwrite" if replace else "errorifexists").partitionBy("accepted").parquet(folder)


def stored_batches(spark: SparkSession, pattern: str, accepted: bool, failed: str = "failed_rules") -> DataFrame:
    """Rows that :func:`store_batches` has put under the folders of ``pattern``; accepted ones without the empty list of failures."""
    rows = spark.read.option("basePath", pattern.split("/*")[0]).parquet(pattern).where(F.col("accepted") == F.lit(accepted)).drop("accepted")
    return rows.drop(failed) if accepted else rows


def release_columns(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Exactly the raw training columns in order, totals as text."""
    require_columns(df, columns)
    return df.select(*[F.col(c).cast("string").alias(c) if c == "TotalCharges" else F.col(c) for c in columns])
