"""Row-level expressions: coercion, target encodings, text and time helpers.

Every function takes and returns a ``Column``, so the work stays in generated JVM code.
Missing is always NULL here: NaN is turned into NULL at each numeric coercion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a binary target.
POSITIVE_WORDS = ("yes", "y", "true", "1", "churn")
NEGATIVE_WORDS = ("no", "n", "false", "0", "no churn")


def to_number(value: Column) -> Column:
    """Number or NULL. Java's type suffixes ('12d', '12f') are not numbers."""
    text = value.cast("string")
    parsed = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.nanvl(parsed, F.lit(None).cast("double"))


def to_number_or_zero(value: Column) -> Column:
    return F.coalesce(to_number(value), F.lit(0.0))


def number_column(df: DataFrame, name: str) -> Column:
    """Number or NULL of a column; a column that already is numeric is not sent through text."""
    value = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return drop_nan(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value.cast("double")
    return to_number(value)


def drop_nan(value: Column) -> Column:
    """Keep a double column's numbers and turn NaN into NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def to_utc_timestamp(value: Column) -> Column:
    """Timestamp in UTC or NULL (session time zone must be UTC for text without an offset)."""
    return value.try_cast("timestamp")


def _words(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string")))


def binary_target(value: Column) -> Column:
    """1, 0, or NULL for a spelling that is not known."""
    words = _words(value)
    return F.when(words.isin(*POSITIVE_WORDS), 1).when(words.isin(*NEGATIVE_WORDS), 0)


def strict_binary_target(value: Column, numeric: bool = False) -> Column:
    """Like :func:`binary_target`, but an unknown spelling fails the job and names the value."""
    if numeric:
        known = F.when(value.isin(0, 1), value.cast("int"))
    else:
        known = binary_target(value)
    problem = F.raise_error(F.concat(F.lit("Neither a yes nor a no: "), value.cast("string")))
    return F.when(value.isNull(), F.lit(None).cast("int")).when(known.isNotNull(), known).otherwise(problem.cast("int"))


def training_target(value: Column) -> Column:
    """Training labels: 'yes' is 1 and everything else is 0."""
    return F.when(F.lower(value.cast("string")) == "yes", 1).otherwise(0)


def label_target(value: Column) -> Column:
    """Delivered labels: yes/1 and no/0; anything else is NULL."""
    words = _words(value)
    return F.when(words.isin("yes", "1"), 1).when(words.isin("no", "0"), 0)


def yes_no(flag: Column) -> Column:
    return F.when(flag == 0, "No").when(flag == 1, "Yes")


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def round_even(value: Column, digits: int) -> Column:
    """Half-even rounding of the binary value to some digits (``F.round`` works on the decimal text, half up)."""
    scale = 10.0**digits
    return F.bround(value * scale, 0) / scale


def over_threshold(score: Column, threshold: float | Column) -> Column:
    return (score >= threshold).cast("int")


def category_text(value: Column, missing: str | None = None) -> Column:
    """Category as text; ``missing`` names the NULL category, if one is wanted."""
    text = value.cast("string")
    return text if missing is None else F.coalesce(text, F.lit(missing))


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def tracked_path(path: Column, track_paths: Sequence[str]) -> Column:
    return F.when(path.isin(*track_paths), path).otherwise("other") if track_paths else path


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def version_id(moment: Column) -> Column:
    return F.date_format(moment, "'ds_'yyyyMMdd_HHmmss")


def order_hash(identity: Column, seed: int) -> Column:
    """Non-negative 60-bit order key of an id under a seed; the same in any engine with md5."""
    digest = F.md5(F.concat(identity.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
