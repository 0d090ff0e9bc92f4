"""Why a score is what it is: linear contributions, top reasons, sums over one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import round_even

NEGLIGIBLE = 1e-6


def linear_impacts(df: DataFrame, identity: str, coefficients: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """One impact column per feature: coefficient x (value - background mean). The background is all of ``df`` unless one is given."""
    background = df if background is None else background
    means = background.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"_m{i}") for i, c in enumerate(coefficients)])
    impacts = [
        ((F.col(f"`{c}`").cast("double") - F.col(f"_m{i}")) * float(w)).alias(c) for i, (c, w) in enumerate(coefficients.items())
    ]
    return df.join(F.broadcast(means)).select(identity, *impacts)


def top_reasons(wide: DataFrame, identity: str, impacts: Sequence[str], top_n: int = 5) -> DataFrame:
    """The ``top_n`` largest impacts of each row with direction and share of the total.

    ``wide`` has one column per feature impact, so ranking happens inside the row and nothing is shuffled.
    """
    entries = F.array(
        *[F.struct(F.abs(F.col(f"`{c}`")).alias("size"), F.lit(c).alias("feature"), F.col(f"`{c}`").alias("impact")) for c in impacts]
    )
    kept = F.filter(entries, lambda e: e.size > NEGLIGIBLE)
    # Descending size, then ascending name.
    ranked = F.array_sort(
        kept,
        lambda a, b: F.when(a.size > b.size, -1)
        .when(a.size < b.size, 1)
        .when(a.feature < b.feature, -1)
        .when(a.feature > b.feature, 1)
        .otherwise(0),
    )
    total = F.aggregate(kept, F.lit(0.0), lambda acc, e: acc + e.size)
    rows = wide.select(identity, total.alias("_total"), F.posexplode(F.slice(ranked, 1, top_n)).alias("pos", "e"))
    return rows.select(
        identity,
        (F.col("pos") + 1).alias("rank"),
        F.col("e.feature").alias("feature"),
        F.col("e.impact").alias("impact"),
        F.when(F.col("e.impact") > 0, "increases_churn").otherwise("reduces_churn").alias("direction"),
        round_even(F.col("e.size") / F.col("_total") * 100, 2).alias("impact_pct"),
    )


def explain_rows(encoded: DataFrame, identity: str, weights: DataFrame, source_of: dict[str, str], top_n: int = 5) -> DataFrame:
    """The ``top_n`` reasons of each row under a fitted linear model, by source column.

    ``weights`` has feature, coefficient and mean (``learning.coefficient_table``). The impact of an encoded column is coefficient x (value - mean), on the scale of the
    log-odds; those of one source column are added up (``source_of``, such as ``OneHotModel.source_of``; other columns stand for themselves). Missing values count as 0, as in the model.
    ``weights`` has a row per column of the encoded table, which bounds what the driver reads; rows are mapped where they are.
    """
    known = {r.feature: (r.coefficient, r.mean) for r in weights.select("feature", "coefficient", "mean").collect()}
    missing = sorted(set(known) - set(encoded.columns))
    if missing:
        raise KeyError(f"The model needs column {missing[0]!r}.")
    impacts = [((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) - m) * w).alias(c) for c, (w, m) in known.items()]
    wide = encoded.select(F.col(f"`{identity}`"), *impacts)
    summed = sum_by_source(wide, {c: source_of.get(c, c) for c in known}, [identity])
    return top_reasons(summed, identity, [c for c in summed.columns if c != identity], top_n)


def sum_by_source(wide: DataFrame, source_of: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Impacts of encoded columns added up per source column; columns that are not there are skipped."""
    groups: dict[str, list[str]] = {}
    for column, source in source_of.items():
        if column in wide.columns:
            groups.setdefault(source, []).append(column)
    sums = []
    for source, columns in groups.items():
        total = F.lit(0.0)
        for c in columns:
            total = total + F.col(f"`{c}`")
        sums.append(total.alias(source))
    return wide.select(*keep, *sums)


def importance_table(importances: Sequence[float], names: Sequence[str], spark, top_n: int | None = None) -> DataFrame:
    """Feature importances of a fitted model, largest first; all of them, or the first ``top_n``. A model has one number per feature."""
    pairs = [(n, float(v)) for n, v in zip(names, importances, strict=True)]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top_n is None else ordered.limit(top_n)
