"""One-hot coding of columns with any number of levels: a ranked vocabulary table, slots and sparse vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.explore import label_codes
from holdfast.operators.features import OneHotModel
from holdfast.operators.joins import join_unique
from holdfast.session import work_dir

#: Columns with more levels than this are coded by a join with the vocabulary instead of by literals.
NARROW = 100
_VOCABULARY = "value string, code bigint, column string"


@dataclass(frozen=True)
class WideModel:
    """Levels of each column in sorted order; the first level of a column gets no slot, like every missing or unknown one.

    The slots of the columns follow each other in the order of ``widths``. ``codes`` (column, value, code) is a stored table; the driver holds one number
    per column, and the levels of narrow columns only.
    """

    codes: DataFrame
    widths: dict[str, int]
    narrow: OneHotModel

    def size(self) -> int:
        return sum(self.widths.values())

    def offsets(self) -> dict[str, int]:
        found, total = {}, 0
        for c, width in self.widths.items():
            found[c] = total
            total += width
        return found

    def slot_names(self) -> DataFrame:
        """(slot, column, name): the columns that ``OneHotModel`` would make, in its order, as a table."""
        start = F.create_map(*[part for c, o in self.offsets().items() for part in (F.lit(c), F.lit(o).cast("bigint"))])
        slot = (start[F.col("column")] + F.col("code") - 1).alias("slot")
        return self.codes.where("code > 0").select(slot, "column", F.concat_ws("_", "column", "value").alias("name"))


def fit_wide(df: DataFrame, columns: Sequence[str], narrow: int = NARROW, path: str | None = None) -> WideModel:
    """Rank the levels of all columns in one job and store them, one folder per column. Missing values are no level."""
    spark = df.sparkSession
    path = path or work_dir(spark, "vocabulary")
    label_codes(df, columns).write.partitionBy("column").parquet(path)
    return load_wide(spark.read.schema(_VOCABULARY).parquet(path), columns, narrow)


def load_wide(codes: DataFrame, columns: Sequence[str], narrow: int = NARROW) -> WideModel:
    """The model of a stored vocabulary."""
    found = {r["column"]: r["top"] for r in codes.groupBy("column").agg(F.max("code").alias("top")).collect()}
    widths = {c: found.get(c, 0) for c in columns}
    few = [c for c in columns if c in found and widths[c] < narrow]
    levels: dict[str, list[str]] = {c: [] for c in columns if c in few or c not in found}
    if few:
        for r in codes.where(F.col("column").isin(few)).collect():
            levels[r["column"]].append(r["value"])
    return WideModel(codes, widths, OneHotModel({c: tuple(sorted(v)) for c, v in levels.items()}))


def _code_of(c: str) -> str:
    return f"_code_{c}"


def _with_codes(df: DataFrame, model: WideModel) -> DataFrame:
    """``df`` with the code of each column beside it: from 0, null where the level is missing or unknown."""
    for c in model.widths:
        text = F.col(f"`{c}`").cast("string")
        if c in model.narrow.levels:
            place = F.array_position(F.array(*[F.lit(v) for v in model.narrow.levels[c]]).cast("array<string>"), text)
            df = df.withColumn(_code_of(c), F.when(place > 0, place - 1))
        else:
            level = "_wide_level"
            table = model.codes.where(F.col("column") == c).select(F.col("value").alias(level), F.col("code").alias(_code_of(c)))
            # A level may hold any share of the rows, so frequent ones are spread.
            df = join_unique(df.withColumn(level, text), table, level, "left").drop(level)
    return df


def _rest(df: DataFrame, model: WideModel) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c not in model.widths]


def encode_slots(df: DataFrame, model: WideModel, output: str = "slots") -> DataFrame:
    """Other columns first, then the slots that are true, ascending. One row per row of ``df``, whatever its repeats and missing values."""
    coded = _with_codes(df, model)
    offsets = model.offsets()
    slots = [F.when(F.col(f"`{_code_of(c)}`") > 0, F.lit(offsets[c]) + F.col(f"`{_code_of(c)}`") - 1) for c in model.widths]
    return coded.select(*_rest(df, model), F.array_compact(F.array(*slots).cast("array<bigint>")).alias(output))


def encode_vectors(df: DataFrame, model: WideModel, numeric: Sequence[str] = (), output: str = "features") -> DataFrame:
    """``df`` and a vector for a learner: the numbers (missing ones as 0), then all slots. Wide rows come out sparse, made in the JVM."""
    spark, columns = df.sparkSession, df.columns
    coded = _with_codes(df, model)
    wide = [c for c, width in model.widths.items() if width > 0]
    for c in wide:
        # The encoder drops its last category: here the first level and those without a slot.
        code = F.col(f"`{_code_of(c)}`")
        coded = coded.withColumn(_code_of(c), F.when(code > 0, code - 1).otherwise(model.widths[c]).cast("double"))
    for i, c in enumerate(numeric):
        coded = coded.withColumn(f"_number_{i}", F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)))
    inputs = [f"_number_{i}" for i in range(len(numeric))]
    if wide:
        shape = spark.range(1).select(*[F.lit(float(model.widths[c])).alias(f"_in_{i}") for i, c in enumerate(wide)])
        places, vectors = [f"_in_{i}" for i in range(len(wide))], [f"_vector_{i}" for i in range(len(wide))]
        encoder = OneHotEncoder(inputCols=places, outputCols=vectors, dropLast=True).fit(shape)
        coded = encoder.transform(coded.withColumns({p: F.col(f"`{_code_of(c)}`") for p, c in zip(places, wide, strict=True)}))
        inputs += vectors
    if not inputs:
        raise ValueError("There is no number and no level to make a vector of.")
    made = VectorAssembler(inputCols=inputs, outputCol=output).transform(coded)
    return made.select(*[F.col(f"`{c}`") for c in columns if c != output], output)
