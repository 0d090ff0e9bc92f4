"""What the operators share: tables, row keys and working copies."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import holdfast
from holdfast.session import work_dir

#: White space as the contracts of the queries mean it: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    found = []
    for name in names:
        while name in df.columns:
            name += "_"
        found.append(name)
    return found


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a missing id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def stored(df: DataFrame, purpose: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` written to the shared working folder and read again: later steps start from files, not from lineage.

    ``group_bytes`` is for rows of a megabyte or so: writers and readers then hold about that much at once, not their usual number of rows.
    """
    path = work_dir(df.sparkSession, purpose)
    writer = df.write
    if group_bytes:
        writer = writer.option("parquet.block.size", str(group_bytes)).option("parquet.block.size.row.check.min", "2").option("parquet.page.size.row.check.min", "2")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_sample(labelled: DataFrame, key: str, limit: int, columns: list[str]) -> DataFrame:
    """About ``limit`` rows of ``labelled``, all if there are no more: those with the smallest hashes of ``key``.

    The choice depends on the key alone, so reruns and retries agree.
    """
    rows = labelled.count()
    share = min(1.0, limit / max(rows, 1))
    if share < 1.0:
        labelled = labelled.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))
    return labelled.select(*columns)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the driver's path and is not installed.

    Where the path does not exist, the launcher must ship the package, as with any other one.
    """
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(holdfast.__file__))), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


Field = tuple[str, str, pa.DataType]


def _parts(batch: pa.RecordBatch, at: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices with about ``most`` bytes of text each, or whole."""
    if most is None or not batch.num_rows:
        yield batch
        return
    place = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at)]) // most
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)


def add_by_text(
    docs: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]], fields: list[Field], drop: tuple[str, ...] = (), most: int | None = None
) -> DataFrame:
    """``docs`` and the ``fields`` (name, Spark type, Arrow type) that a function makes of each batch of texts, where the texts are read.

    ``make`` builds that function once per task. Other columns pass by untouched, so large ids and missing values stay what they are; those
    in ``drop`` end here. ``most`` bounds the bytes of text that are worked on at once, for functions whose results are larger than the texts.
    """
    workers_import(docs.sparkSession)
    at = docs.columns.index(text_col)
    stay = [i for i, name in enumerate(docs.columns) if name not in drop]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for whole in batches:
            for batch in _parts(whole, at, most):
                made = run(batch.column(at).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=kind) for x, (_, _, kind) in zip(made, fields, strict=True)]
                schema = pa.schema([*[batch.schema.field(i) for i in stay], *[(name, kind) for name, _, kind in fields]])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], *arrays], schema=schema)

    kinds = [f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}" for i in stay]
    return docs.mapInArrow(work, ", ".join([*kinds, *[f"{name} {kind}" for name, kind, _ in fields]]))


def map_texts(
    docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list], list]], fields: list[Field], most: int | None = None
) -> DataFrame:
    """doc_id and the ``fields`` that a function makes of each batch of texts; see ``add_by_text``."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return add_by_text(source, "text", make, fields, ("text",), most)
