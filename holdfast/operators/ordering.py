"""Global order without a single-task sort.

AUC, average precision, ROC points, KS, exact quantiles and rank limits all need running totals over an
ordered key. A window without partitions would pull every row into one task, and a window by class or by
feature has the same flaw when there are only a few of them. The shape used here:

1. collapse to one row per key value (partial aggregation absorbs hot values and handles ties exactly);
2. cut the value range at boundaries taken from a sample of the collapsed keys, chosen by a hash of the key,
   so the same data always gives the same boundaries, whichever task or retry computes them;
3. running totals inside each (group, bucket), in parallel;
4. add the totals of earlier buckets, a table of one row per bucket and group.

The collapse is the only shuffle that depends on the input size; the later branches reuse its files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Sampled keys per bucket. The size of a bucket then varies little around its mean.
_OVERSAMPLING = 8


def default_buckets(spark: SparkSession) -> int:
    """Buckets for a global order: a few per shuffle partition, however many there are."""
    return max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_points(collapsed: DataFrame, key: str, groups: list[str], buckets: int) -> DataFrame:
    """One row per group with its sorted boundaries; all groups together hold about ``buckets`` values."""
    wanted = buckets * _OVERSAMPLING
    rows = collapsed.agg(F.count("*").alias("n"))
    rate = F.greatest(F.lit(1), F.expr(f"n div {wanted}"))
    sampled = (
        collapsed.select(*groups, key)
        .join(F.broadcast(rows.select(rate.alias("_every"))))
        .where(F.pmod(F.xxhash64(*groups, F.col(key)), F.col("_every")) == 0)
    )
    ordered = sampled.groupBy(*groups).agg(F.array_sort(F.collect_list(key)).alias("_keys"))
    every = F.filter("_keys", lambda _, i: (i + 1) % _OVERSAMPLING == 0)
    return ordered.select(*groups, every.alias("_bounds"))


def with_bucket(tagged: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, the number of boundaries below the key, and drop the boundary array.

    Binary search as a chain of columns, one per halving step. Each refers to the one before it, so the planner
    keeps them apart and compiles the whole chain; a higher-order function would be interpreted for every row.
    """
    bounds, value = F.col("_bounds"), F.col(key)
    low, chain = F.lit(0), []
    # A sample of one in ``n div wanted`` has less than twice the wanted size; twice that again is more than chance adds.
    for i in range((4 * buckets).bit_length() - 1, -1, -1):
        step = 1 << i
        # Past the end of the array there is no value, and the comparison does not hold.
        above = F.get(bounds, low + (step - 1)) < value
        chain.append((low + F.when(above, step).otherwise(0)).alias(f"_low{i}"))
        low = F.col(f"_low{i}")
    kept = [c for c in tagged.columns if c != "_bounds"]
    return tagged.select(*kept, "_bounds", *chain).select(*kept, low.alias("_bucket"))


def collapse(df: DataFrame, key: str, sums: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, key) with the given sums. Missing groups and keys, and keys with nothing but zeros, are left out.

    The filters are stated here, before the shuffle, because the planner would otherwise add them to some of the
    branches that read it and make the shuffle once more for those.
    """
    present = F.lit(True)
    for name in (*groups, key):
        present = present & F.col(name).isNotNull()
    totals = df.where(present).groupBy(*groups, key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # Asking for every sum keeps the shuffle identical in all branches that read it, so it is made once.
    some = F.lit(False)
    for name in sums:
        some = some | (F.col(name) != 0)
    return totals.where(some)


def running_totals(
    collapsed: DataFrame, key: str, sums: Sequence[str], groups: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Add ``cum_<s>`` (sum up to and including the row's key) and ``all_<s>`` (sum over the group).

    ``collapsed`` must come from :func:`collapse`: one row per (group, key).
    """
    buckets = buckets or default_buckets(collapsed.sparkSession)
    groups = list(groups)
    if groups:
        bounds = cut_points(collapsed, key, groups, buckets)
        tagged = collapsed.join(F.broadcast(bounds), groups, "left")
    else:
        bounds = cut_points(collapsed, key, groups, buckets)
        tagged = collapsed.join(F.broadcast(bounds))
    tagged = with_bucket(tagged, key, buckets)

    by_bucket = [*groups, "_bucket"]
    inside = W.partitionBy(*by_bucket).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = tagged.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])

    sizes = tagged.groupBy(*by_bucket).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    earlier = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = sizes.select(
        *by_bucket,
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    joined = local.join(offsets, by_bucket)
    return joined.select(
        *collapsed.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    nearest: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """Exact quantiles in long form: (groups..., probability, quantile).

    ``nearest`` takes the value at the half-even rounded index (n-1)p; otherwise neighbours are interpolated.
    """
    weight = F.lit(1) if weight is None else weight
    collapsed = collapse(df, value, {"_n": weight.cast("bigint")}, groups)
    ranked = running_totals(collapsed, value, ["_n"], groups)

    def places(p: float) -> tuple[Column, Column, Column]:
        place = (F.col("all__n") - 1) * F.lit(float(p))
        low, high = (F.bround(place), F.bround(place)) if nearest else (F.floor(place), F.ceil(place))
        return low.cast("bigint"), high.cast("bigint"), place - low

    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1
    targets = {float(p): places(p) for p in probabilities}
    hit = F.lit(False)
    for low, high, _ in targets.values():
        hit = hit | low.between(first, last) | high.between(first, last)
    # Only the few rows that hold a wanted rank reach the explode.
    hits = ranked.where(hit).select(
        *groups,
        value,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("probability"), low.alias("low"), high.alias("high"), part.alias("part"))
                    for p, (low, high, part) in targets.items()
                ]
            )
        ).alias("q"),
        first.alias("first"),
        last.alias("last"),
    )
    low_value = F.max(F.when(F.col("q.low").between(F.col("first"), F.col("last")), F.col(value)))
    high_value = F.max(F.when(F.col("q.high").between(F.col("first"), F.col("last")), F.col(value)))
    return (
        hits.groupBy(*groups, F.col("q.probability").alias("probability"))
        .agg(low_value.alias("low"), high_value.alias("high"), F.max("q.part").alias("part"))
        .select(*groups, "probability", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))
    )
