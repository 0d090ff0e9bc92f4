"""Feature steps: numeric coercion, one-hot encoding with a fitted vocabulary, scaling and filling."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import DEFAULT_STEPS, FeatureSettings
from holdfast.functions.scalars import drop_nan, number_column
from holdfast.operators.naming import drop_present, feature_names


@dataclass(frozen=True)
class OneHotModel:
    """Sorted levels of each column, first level first (the one that gets no column)."""

    levels: dict[str, tuple[str, ...]]

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.levels.items() for v in values[1:]]

    def source_of(self) -> dict[str, str]:
        """Encoded column to source column."""
        return {f"{c}_{v}": c for c, values in self.levels.items() for v in values[1:]}

    def to_json(self) -> str:
        return json.dumps({c: list(v) for c, v in self.levels.items()})

    @classmethod
    def from_json(cls, text: str) -> OneHotModel:
        return cls({c: tuple(v) for c, v in json.loads(text).items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """Other columns first, then boolean columns; an unknown or missing level is false in all of them."""
        rest = [F.col(f"`{c}`") for c in df.columns if c not in self.levels]
        coded = [
            F.coalesce(F.col(f"`{c}`").cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
            for c, values in self.levels.items()
            for v in values[1:]
        ]
        return df.select(*rest, *coded)


def long_rows(df: DataFrame, values: dict[str, Column], name: str = "feature", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., name, value) rows of several expressions of one type, read in one pass.

    ``unpivot`` would do the same, but copies of its plan do not compare as equal, so a shuffle after it could
    not be shared between the branches of a query.
    """
    entries = F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in values.items()])
    return df.select(*keep, F.inline(entries))


def long_text(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., name, text value) rows of several columns."""
    return long_rows(df, {c: F.col(f"`{c}`").cast("string") for c in columns}, name, value, keep)


def names_frame(spark: SparkSession, names: Sequence[str], column: str = "feature") -> DataFrame:
    """One row per name, made in the JVM."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(column))


def fit_one_hot(df: DataFrame, columns: Sequence[str], most: int | None = None) -> OneHotModel:
    """Levels of all columns in one job. Each level becomes a column of the encoded table, so the driver gets as many values as that
    table has columns. ``most`` makes it an error if a column has more levels; such a column is better coded by ``explore.label_codes``."""
    levels = long_text(df, columns).where("value IS NOT NULL").distinct()
    if most is not None:
        wide = levels.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") > most).orderBy("feature").first()
        if wide:
            raise ValueError(f"{wide.feature} has {wide.n} levels, more than {most}.")
    found = levels.collect()
    by_column: dict[str, list[str]] = {c: [] for c in columns}
    for row in found:
        by_column[row.feature].append(row.value)
    return OneHotModel({c: tuple(sorted(v)) for c, v in by_column.items()})


def cast_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.coalesce(number_column(df, c), F.lit(0.0)) for c in present}) if present else df


def cast_encoded_to_bool(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns named after a category column become boolean."""
    prefixes = tuple(f"{c}_" for c in columns)
    return df.select(
        *[F.col(f"`{c}`").cast("boolean").alias(c) if prefixes and c.startswith(prefixes) else F.col(f"`{c}`") for c in df.columns]
    )


Step = Callable[[DataFrame, FeatureSettings, "OneHotModel | None"], DataFrame]


def _encode(df: DataFrame, settings: FeatureSettings, model: OneHotModel | None) -> DataFrame:
    model = model or fit_one_hot(df, settings.categorical_columns)
    return model.transform(df)


# Named steps; add to this table to extend the pipeline.
STEPS: dict[str, Step] = {
    "clean_names": lambda df, s, m: feature_names(df),
    "cast_numeric_types": lambda df, s, m: cast_numeric(df, s.cast_to_numeric),
    "encode_categoricals": _encode,
    "drop_configured": lambda df, s, m: drop_present(df, s.drop_columns),
    "cast_ohe_to_bool": lambda df, s, m: cast_encoded_to_bool(df, s.categorical_columns),
}


def build_features(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), model: OneHotModel | None = None, steps: Sequence[str] | None = None
) -> DataFrame:
    """Run the configured steps in order. Pass a fitted ``model`` to encode new data with the training levels."""
    names = settings.enabled_steps if steps is None else steps
    if names is None:
        names = DEFAULT_STEPS
    unknown = [n for n in names if n not in STEPS]
    if unknown:
        raise ValueError(f"There is no feature step named {unknown[0]!r}.")
    for name in names:
        df = STEPS[name](df, settings, model)
    return df


def standardize(train: DataFrame, columns: Sequence[str], *others: DataFrame) -> list[DataFrame]:
    """Zero mean and unit population deviation, fitted on ``train``; a constant column is only centered."""
    moments = train.agg(
        *[F.avg(drop_nan(F.col(c))).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(drop_nan(F.col(c))).alias(f"_s_{c}") for c in columns],
    )
    scale = {c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}

    def apply(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(moments))
        scaled = {c: (F.col(c).cast("double") - F.col(f"_m_{c}")) / scale[c] for c in columns}
        return joined.withColumns(scaled).select(*df.columns)

    return [apply(df) for df in (train, *others)]


def fill_with_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers replaced by their column's mean."""
    means = df.agg(*[F.avg(drop_nan(F.col(c))).alias(f"_m_{c}") for c in columns])
    filled = {c: F.coalesce(drop_nan(F.col(c)), F.col(f"_m_{c}")) for c in columns}
    return df.join(F.broadcast(means)).withColumns(filled).select(*df.columns)
