"""Reading and writing tables, batch folders, history tables and exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.validation import require_rows

FORMATS = ("parquet", "csv")
# Fixed value: column order of a prioritized export.
EXPORT_COLUMNS = ("customer_id", "churn_probability", "customer_value", "action", "expected_value")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _format(path: str, fmt: str | None) -> str:
    kind = fmt or PurePosixPath(path).suffix.lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"Tables are read and written as {FORMATS}, not as {kind!r}.")
    return kind


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Table by suffix or format. Text is never sampled for types: CSV columns are strings unless a schema is given."""
    kind = _format(path, fmt)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"There is nothing at {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path) if kind == "parquet" else reader.option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Overwrite a table; Spark makes the parent folders."""
    kind = _format(path, fmt)
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)


def read_batches(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.csv", batch: str = "batch_file") -> DataFrame:
    """All batch files of a folder with the file name of each row; a missing folder is an empty table."""
    out = T.StructType([*schema.fields, T.StructField(batch, T.StringType())])
    if not path_exists(spark, folder):
        return spark.createDataFrame([], out)
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(folder)
    return rows.select("*", F.col("_metadata.file_path").alias(batch))


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str | None:
    """Newest file of a folder. Only file listings are read, not contents."""
    if not path_exists(spark, folder):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    newest = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first().m
    return newest.path if newest else None


def read_latest_batch(spark: SparkSession, folder: str, fallback: str, schema: T.StructType, pattern: str = "*.csv") -> DataFrame:
    """Rows of the newest batch file, or of the fallback file if there is none."""
    path = latest_file(spark, folder, pattern) or fallback
    return spark.read.schema(schema).option("header", True).csv(path)


def records_to_table(spark: SparkSession, records: Sequence[dict], schema: T.StructType | None = None) -> DataFrame:
    """Request records as a table; no records is an error."""
    if not records:
        raise ValueError("The request holds no rows.")
    names = list(dict.fromkeys(k for r in records for k in r))
    if schema is None:
        return spark.createDataFrame([Row(**{n: r.get(n) for n in names}) for r in records])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


def read_requests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines requests from a folder, with the given types; an empty folder is an error."""
    return require_rows(spark.read.schema(schema).json(path), "The request holds no rows.")


def append_history(rows: DataFrame, path: str, moment: str | None = "timestamp", at: Column | None = None) -> DataFrame:
    """Append check results to a history table: new files only, whatever the size of the history. Returns the rows as stored.

    They are computed once: the caller gets them from the table, by the id of this append (``append_id``).
    """
    if moment and moment not in rows.columns:
        rows = rows.withColumn(moment, at if at is not None else F.current_timestamp())
    append = uuid.uuid4().hex
    rows.withColumn("append_id", F.lit(append)).write.mode("append").parquet(path)
    stored = rows.sparkSession.read.schema(rows.withColumn("append_id", F.lit(append)).schema).parquet(path)
    return stored.where(F.col("append_id") == append).drop("append_id")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History table; later checks may have more columns."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("append_id")


def export_prioritized(prioritized: DataFrame, folder: str, today: Column | None = None) -> str:
    """Write a prioritized list as CSV in the fixed column order under a dated name, and return its path."""
    columns = [c for c in EXPORT_COLUMNS if c in prioritized.columns]
    spark = prioritized.sparkSession
    day = today if today is not None else F.current_date()
    stamp = spark.range(1).select(F.date_format(day, "yyMMdd").alias("d")).first().d
    path = f"{folder}/{stamp}_prioritized_customers.csv"
    write_table(prioritized.select(*columns), path)
    return path


def archive(df: DataFrame, folder: str, stamp: str) -> str:
    """Keep a processed table under ``run_ts=<stamp>`` of the archive."""
    path = f"{folder}/run_ts={stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path
