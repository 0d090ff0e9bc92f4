"""Rank limits, stratified splits and seeded samples, found as a cut rather than by ranking every row.

A selection of k rows in a total order (value, then id) is described by its last row. Finding that row needs
running totals over collapsed values; applying it is a plain filter, so the rows themselves are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.functions.scalars import drop_nan, order_hash
from holdfast.operators.ordering import collapse, running_totals

# Coarse cells of a 60-bit hash: 2**16 per class.
_CELL_SHIFT = 44


# Cells per power of two: a cell spans values that differ by 0.07 % at most.
_CELLS_PER_OCTAVE = 1024
# More than the largest negative binary exponent of a double, so that cells of positive values are positive.
_EXPONENT_SHIFT = 1100


def value_cell(value: Column) -> Column:
    """A whole number that never falls when the value grows, from its sign and binary logarithm. Values of very different size get cells of the same relative width."""
    v = value.cast("double")
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1024.0)) + _EXPONENT_SHIFT) * _CELLS_PER_OCTAVE).cast("bigint")
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).when(v < 0, -size)


def top_flag(
    df: DataFrame, value: str, identity: str, flag: str, k: int | None = None, share: float | None = None, positive_only: bool = True
) -> DataFrame:
    """Add a boolean that marks the ``k`` largest rows by ``value`` (or that share of all rows), ties in ``identity`` order.

    ``identity`` must be unique. With ``positive_only`` rows at or below zero take part in the ranking but are
    never marked. A share is taken of all rows, also of those without a value, which are never marked. Any ``k`` and any share take
    one way: rows are counted by cells of their value, which partial aggregation does where they are read; only the cell in which the
    selection ends is put in order, by running totals; a filter then marks the rows up to its last one. Nothing runs before the result is asked for.
    """
    present = drop_nan(F.col(value))
    eligible = (present > 0) if positive_only else present.isNotNull()
    # The hash keeps the id among the columns read, so that shuffles below ``df`` are the same here and where rows are ordered, and are made once.
    cells = df.groupBy(value_cell(present).alias("_cell")).agg(F.count("*").alias("_n"), F.max(F.xxhash64(identity)).alias("_h")).where("_h IS NOT NULL")
    # One row per cell from here on.
    valued = F.sum(F.when(F.col("_cell").isNotNull(), F.col("_n"))).over(W.partitionBy())
    wanted = F.lit(int(k)) if share is None else F.floor(F.sum("_n").over(W.partitionBy()) * F.lit(float(share)))
    down = W.orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = cells.select("_cell", "_n", F.least(wanted, valued).cast("bigint").alias("_wanted")).where("_cell IS NOT NULL").withColumn("_upto", F.sum("_n").over(down))
    last_cell = (F.col("_wanted") > 0) & (F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted"))
    crossing = counted.where(last_cell).select(F.col("_cell").alias("_crossing"), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take"))

    place = F.struct((-present).alias("value"), F.col(identity).alias("id"))
    inside = df.select(place.alias("_place"), value_cell(present).alias("_cell")).join(F.broadcast(crossing), F.col("_cell") == F.col("_crossing"))
    ranked = running_totals(collapse(inside.select("_place"), "_place", {"_n": F.lit(1)}), "_place", ["_n"])
    found = (F.col("cum__n") >= F.col("_take")) & (F.col("cum__n") - F.col("_n") < F.col("_take"))
    cut = ranked.join(F.broadcast(crossing)).where(found).select(F.col("_place").alias("_cut"))
    marked = df.join(F.broadcast(cut), F.lit(True), "left")
    return marked.withColumn(flag, F.coalesce(eligible & (place <= F.col("_cut")), F.lit(False))).drop("_cut")


def stratified_split(df: DataFrame, identity: str, stratum: str, test_size: float, seed: int, flag: str = "is_validation") -> DataFrame:
    """Mark a seeded validation part with exact class shares.

    The part has ceil(test_size * n) rows, shared over the classes by largest remainder. In each class the rows
    with the smallest (hash of id and seed, id) are taken. Classes are few, so their counts are a small table;
    the cut of a class is found by counting coarse hash cells and then ordering one cell of it. Rows without a class form one.
    """
    # The class as a name that is never missing, so that rows without a class are a class of their own in the joins.
    name = F.when(F.col(stratum).isNull(), "").otherwise(F.concat(F.lit("="), F.col(stratum).cast("string")))
    hashed = df.withColumn("_h", order_hash(F.col(identity), seed)).withColumn("_k", name)
    cell = F.shiftright("_h", _CELL_SHIFT)
    cells = hashed.groupBy("_k", cell.alias("_cell")).agg(F.count("*").alias("_n"))

    sizes = cells.groupBy("_k").agg(F.sum("_n").alias("_class"))
    every = W.partitionBy()
    wanted = F.ceil(F.sum("_class").over(every) * test_size)
    share = F.col("_class") * wanted / F.sum("_class").over(every)
    shares = sizes.select("_k", wanted.alias("_wanted"), F.floor(share).alias("_floor"), (share - F.floor(share)).alias("_rest"))
    left_over = F.col("_wanted") - F.sum("_floor").over(every)
    order = F.row_number().over(W.orderBy(F.desc("_rest"), F.col("_k")))
    quotas = shares.select("_k", (F.col("_floor") + F.when(order <= left_over, 1).otherwise(0)).alias("_quota"))

    before = F.sum("_n").over(W.partitionBy("_k").orderBy("_cell")) - F.col("_n")
    crossing = (
        cells.select("_k", "_cell", "_n", before.alias("_before"))
        .join(quotas, "_k")
        .where((F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("_n") >= F.col("_quota")))
        .select("_k", "_cell", (F.col("_quota") - F.col("_before")).alias("_take"))
    )
    inside = hashed.select("_k", cell.alias("_cell"), "_h", F.col(identity).alias("_id")).join(crossing, ["_k", "_cell"])
    rank = F.row_number().over(W.partitionBy("_k").orderBy("_h", "_id"))
    cuts = inside.select("_k", "_h", "_id", "_take", rank.alias("_rank")).where("_rank = _take").select(
        "_k", F.col("_h").alias("_cut"), F.col("_id").alias("_cut_id")
    )
    tagged = hashed.join(cuts, "_k", "left")
    taken = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col(identity) <= F.col("_cut_id")))
    return tagged.withColumn(flag, F.coalesce(taken, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns], flag)


def seeded_sample(df: DataFrame, identity: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows in an order that depends on the id and the seed only."""
    return df.withColumn("_h", order_hash(F.col(identity), seed)).orderBy("_h", identity).limit(n).drop("_h")


def next_batch(df: DataFrame, identity: str, size: int, after: object = None) -> DataFrame:
    """The next ``size`` rows in id order after the last id already taken; the rest stays in the pool."""
    pool = df if after is None else df.where(F.col(identity) > F.lit(after))
    return pool.orderBy(identity).limit(size)


def remainder(df: DataFrame, batch: DataFrame, identity: str) -> DataFrame:
    """Rows of the pool behind the given batch."""
    last = batch.agg(F.max(identity).alias("_last"))
    return df.join(F.broadcast(last), F.lit(True), "left").where(
        F.col("_last").isNull() | (F.col(identity) > F.col("_last"))
    ).drop("_last")


def class_shares(df: DataFrame, label: str, groups: list[str] | None = None) -> DataFrame:
    """Rows and share of each class (inside each group, if given)."""
    groups = groups or []
    # Only counts per class reach the window.
    counted = df.groupBy(*groups, label).agg(F.count("*").alias("n"))
    whole = W.partitionBy(*groups)
    return counted.withColumn("share", F.col("n") / F.sum("n").over(whole))

