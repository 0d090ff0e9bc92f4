"""Feature schema: capture it once, replay it on every batch to be scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.scalars import drop_nan


def capture_schema(df: DataFrame) -> str:
    """Column order and types as JSON."""
    return df.schema.json()


def load_schema(text: str) -> T.StructType:
    import json

    return T.StructType.fromJson(json.loads(text))


def _number(c: Column) -> Column:
    return drop_nan(c.cast("string").try_cast("double"))


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order and type: missing ones are 0, extra ones are dropped."""
    present = set(df.columns)

    def one(field: T.StructField) -> Column:
        zero = F.lit(0).cast("string" if isinstance(field.dataType, T.StringType) else field.dataType)
        if field.name not in present:
            return zero.alias(field.name)
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return value.cast("string").alias(field.name)
        return F.coalesce(value.cast("string").try_cast(field.dataType), zero).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def cast_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Numbers back to schema types: booleans by non-zero, whole numbers after half-even rounding."""
    present = set(df.columns)

    def one(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            return (value != 0).alias(field.name)
        if isinstance(field.dataType, T.IntegralType):
            return F.bround(value).cast(field.dataType).alias(field.name)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema.fields if f.name in present])


def numeric_input(df: DataFrame, codes: dict[str, list[str]] | None = None) -> DataFrame:
    """All columns as doubles with no gaps: booleans 0/1, categories by the position in ``codes`` (-1 if missing)."""
    codes = codes or {}

    def one(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if field.name in codes:
            place = F.array_position(F.array(*[F.lit(v) for v in codes[field.name]]), value.cast("string"))
            return F.coalesce(place.cast("double") - 1.0, F.lit(-1.0)).alias(field.name)
        if isinstance(field.dataType, T.BooleanType):
            return F.coalesce(value.cast("double"), F.lit(0.0)).alias(field.name)
        return F.coalesce(_number(value), F.lit(0.0)).alias(field.name)

    return df.select(*[one(f) for f in df.schema.fields])
