"""Files that arrive in an inbox: validate each, accept it whole or quarantine it whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast.operators.validation import CUSTOMER_CONTRACT, FieldRule, apply_contract, store_batches


def read_inbox(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv", files_per_batch: int = 1000, archive: str | None = None
) -> DataFrame:
    """Stream of new files with their name as ``batch_file``; finished files move to ``archive`` if one is given."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.format(fmt).load(folder).select("*", F.col("_metadata.file_path").alias("batch_file"))


def ingest_inbox(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    contract: Sequence[FieldRule] = CUSTOMER_CONTRACT,
    batch: str = "batch_file",
    available_now: bool = True,
) -> StreamingQuery:
    """Validate new batches and put them under ``folder``, as accepted or quarantined; ``validation.stored_batches`` reads either.

    Each micro-batch writes its own folder and replaces it on a replay, so a restart adds no duplicates.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        store_batches(apply_contract(rows, contract), batch, f"{folder}/micro_batch={batch_id}", replace=True)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
