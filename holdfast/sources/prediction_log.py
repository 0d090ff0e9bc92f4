"""The prediction log: a date-partitioned table that is only ever appended to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.naming import to_log_id

SERVICE = "prediction_api"


def enrich(
    decided: DataFrame,
    environment: str = "dev",
    model_alias: str | None = None,
    model_version: str | None = None,
    model_run_id: str | None = None,
    request_id: str | None = None,
    at: Column | None = None,
) -> DataFrame:
    """Add id, UTC time and date, environment and model facts to decided rows.

    The id is a hash of the request, the time and the row, so every reader of this frame gets the same one. Rows of one request that are
    equal in all columns get one id; give rows an id of their own to tell them apart.
    """
    moment = at if at is not None else F.current_timestamp()
    facts = {
        "environment": environment,
        "model_alias": model_alias,
        "model_version": model_version,
        "model_run_id": model_run_id,
        "request_id": request_id,
    }
    return decided.withColumns(
        {
            "prediction_id": F.md5(F.to_json(F.struct(F.lit(request_id).alias("_request"), moment.alias("_moment"), *[F.col(f"`{c}`") for c in decided.columns]))),
            "prediction_timestamp": moment,
            "prediction_date": F.to_date(moment),
            **{name: F.lit(value).cast("string") for name, value in facts.items()},
        }
    )


def as_json(log: DataFrame, inputs: list[str]) -> DataFrame:
    """One structured JSON line per prediction, with the inputs nested."""
    rest = [c for c in log.columns if c not in inputs]
    line = F.struct(F.struct(*inputs).alias("input"), *rest, F.lit(SERVICE).alias("service"))
    return log.select(F.to_json(line).alias("value"))


def append(log: DataFrame, path: str) -> None:
    """Add rows to the log; each day is a folder, so readers prune by date. Rows of a day meet in few files; a large day is split."""
    log.hint("rebalance", "prediction_date").write.mode("append").partitionBy("prediction_date").parquet(path)


def read_request(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """Logged rows of one request; the filter is pushed to the files."""
    log = spark.read.parquet(path)
    if "request_id" not in log.columns:
        raise KeyError("The log has no request_id column.")
    return to_log_id(log.where(F.col("request_id") == request_id))


def check_request(rows: DataFrame, expected_rows: int) -> str | None:
    """None if the request has the expected rows, else a warning text; no rows at all is an error."""
    found = rows.count()
    if not found:
        raise ValueError("The log has no row of this request.")
    return None if found == expected_rows else f"Expected {expected_rows} logged predictions, found {found}."
