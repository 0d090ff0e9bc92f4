"""Joins that stay whole and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def join_unique(left: DataFrame, right: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join ``left`` to ``right``, whose ``on`` values are unique, spreading hot keys of ``left``.

    A key is hot when it holds more rows than half an average partition; it gets as many sub-keys as keep each below that. So there are
    at most two hot keys per shuffle partition, which bounds the broadcast of them, and at most three sub-keys per partition in all. Rows
    of a hot key are spread over its sub-keys by a hash of the whole row (which a retry repeats, unlike a random number); only
    the matching right rows are copied. Other rows keep sub-key 0. ``counts`` gives (key, ``_rows``) of the left side if it is known already, which saves a pass over it.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"A join must be inner or left, not {how!r}.")
    if counts is None:
        counts = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_rows"))
    halves = 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = counts.agg(F.greatest(F.sum("_rows") / halves, F.lit(1)).alias("_limit"))
    hot = counts.join(F.broadcast(limit)).where(F.col("_rows") > F.col("_limit")).select(on, F.ceil(F.col("_rows") / F.col("_limit")).cast("int").alias("_salts"))

    hashable = [F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    row_hash = F.xxhash64(*hashable)

    def named(df: DataFrame) -> list[Column]:
        return [F.col(f"`{c}`") for c in df.columns]

    spread = (
        F.when(F.col("_salts").isNotNull(), F.pmod(row_hash, F.col("_salts")).cast("int"))
        # A missing key matches nothing, so its rows may go anywhere.
        .when(F.col(on).isNull(), F.pmod(row_hash, F.lit(1 << 20)).cast("int"))
        .otherwise(0)
    )
    salted = left.join(F.broadcast(hot), on, "left").select(*named(left), spread.alias("_salt"))
    copies = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    copied = right.join(F.broadcast(hot), on, "left").select(*named(right), F.explode(copies).alias("_salt"))
    return salted.join(copied, [on, "_salt"], how).drop("_salt")
