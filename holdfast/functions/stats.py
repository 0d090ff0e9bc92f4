"""Tail probabilities, evaluated on one row per test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SERIES_TERMS = 100
_FRACTION_DEPTH = 60


def kolmogorov_tail(statistic: Column, reference_n: Column, current_n: Column) -> Column:
    """P(K > sqrt(nm/(n+m)) D), the large-sample two-sided KS p-value."""
    n, m = reference_n.cast("double"), current_n.cast("double")
    z = F.sqrt(n * m / (n + m)) * statistic
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * z * z),
    )
    # Below 0.2 the series is 1 to double precision but converges too slowly to show it.
    return F.when(z < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def with_kolmogorov_exact(df: DataFrame, statistic: str, reference_n: str, current_n: str, output: str, most_cells: int) -> DataFrame:
    """``df`` with the exact P(D >= statistic) of two samples without ties; null where the statistic is missing, a sample is empty or their sizes multiply to more than ``most_cells``.

    If both samples have one distribution, drawing their values in order is a walk over a lattice that takes the next value from either sample in proportion to what it has
    left. ``p`` holds the chances of the places, from ``low`` on, whose distance has stayed below the statistic; what steps out of this band is summed up, so small
    p-values keep their leading digits. A step costs as many operations as the band is wide: 2 * statistic * reference_n * current_n in all.
    """
    a, b, gap = F.col("_a"), F.col("_b"), F.col("_gap")
    out = df.withColumns({"_a": F.least(reference_n, current_n).cast("bigint"), "_b": F.greatest(reference_n, current_n).cast("bigint")})
    out = out.withColumn("_gap", F.round(F.col(statistic) * a * b).cast("bigint"))
    usable = (a > 0) & (a * b <= most_cells) & gap.isNotNull()

    def step(state: Column, t: Column) -> Column:
        left = (a + b - t + 1).cast("double")
        low = F.greatest(F.lit(0).cast("bigint"), t - b, F.floor((t * a - gap) / (a + b)) + 1)
        high = F.least(a, t, F.ceil((t * a + gap) / (a + b)) - 1)

        def before(i: Column) -> Column:
            return F.coalesce(F.get(state.p, (i - state.low).cast("int")), F.lit(0.0))

        inside = F.transform(F.sequence(low, high), lambda i: (before(i - 1) * (a - i + 1) + before(i) * (b - t + 1 + i)) / left)
        top = state.low + F.size(state.p) - 1
        over = F.when(top + 1 > high, before(top) * (a - top) / left).otherwise(0.0)
        under = F.when(state.low < low, before(state.low) * (b - t + 1 + state.low) / left).otherwise(0.0)
        return F.struct(
            low.alias("low"),
            F.when(high >= low, inside).otherwise(F.array().cast("array<double>")).alias("p"),
            (state.outside + over + under).alias("outside"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("low"), F.array(F.lit(1.0)).alias("p"), F.lit(0.0).alias("outside"))
    steps = F.when(usable & (gap > 0), F.sequence(F.lit(1).cast("bigint"), a + b)).otherwise(F.array().cast("array<bigint>"))
    walked = F.aggregate(steps, start, step, lambda state: state.outside)
    found = F.when(usable, F.when(gap > 0, F.least(walked, F.lit(1.0))).otherwise(1.0))
    return out.select(*df.columns, found.alias(output))


def _erfc(z: Column) -> Column:
    """Complementary error function for z >= 0: power series below 2.5, continued fraction above."""
    gauss = F.exp(-z * z)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_FRACTION_DEPTH)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, n: F.struct(
            (acc.term * 2.0 * z * z / (2 * n + 1)).alias("term"),
            (acc.total + acc.term * 2.0 * z * z / (2 * n + 1)).alias("total"),
        ),
        lambda acc: acc.total,
    )
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_DEPTH), F.lit(1), F.lit(-1)), z, lambda acc, n: z + (n / 2.0) / acc
    )
    root_pi = math.sqrt(math.pi)
    return F.when(z < 2.5, 1.0 - 2.0 / root_pi * gauss * series).otherwise(gauss / (root_pi * fraction))


# Up to this many degrees the finite sum is used; beyond, the uniform expansion, whose error falls with the degrees.
_SUM_DEGREES = 200
# Taylor coefficients of the first two terms of the uniform expansion of the incomplete gamma ratio around its middle.
_FIRST_TERM = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600)
_SECOND_TERM = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def with_chi_square_tail(df: DataFrame, statistic: str, dof: str, output: str) -> DataFrame:
    """``df`` with P(X > statistic) for a chi-square with whole ``dof``; 1 when dof is 0. The work does not depend on ``dof``.

    With few degrees, the upper gamma ratio is a finite sum: start from exp(-x) or erfc(sqrt x) and add x^a e^-x / Gamma(a + 1) for a below dof / 2; the
    exponential is then zero only where the tail is. With many, it is erfc of a transformed distance from the mean, and two terms of the correction. Every value that is
    used again is a column of its own, so the planner keeps it apart and computes it once.
    """
    x, k, few, even, a = (F.col(f"_{n}") for n in ("x", "k", "few", "even", "a"))
    step, half_square, eta, erfc = (F.col(f"_{n}") for n in ("step", "half_square", "eta", "erfc"))
    out = df.withColumns({"_x": F.col(statistic) / 2.0, "_k": F.col(dof).cast("bigint")})
    out = out.withColumns({"_few": k <= _SUM_DEGREES, "_even": k % 2 == 0, "_a": F.greatest(k, F.lit(1)).cast("double") / 2.0})
    out = out.withColumn("_step", x / a - 1.0)
    # step - ln(1 + step), which cancels near zero, from its own series there.
    near = step * step * (0.5 - step / 3.0 + step * step / 4.0 - step * step * step / 5.0 + F.pow(step, F.lit(4)) / 6.0 - F.pow(step, F.lit(5)) / 7.0)
    out = out.withColumn("_half_square", F.when(F.abs(step) < 0.005, near).otherwise(step - F.log1p(step)))
    out = out.withColumn("_eta", F.signum(step) * F.sqrt(2.0 * half_square))
    out = out.withColumn("_z", F.when(few, F.sqrt(F.greatest(x, F.lit(0.0)))).otherwise(F.abs(eta) * F.sqrt(a / 2.0)))
    out = out.withColumn("_erfc", _erfc(F.col("_z")))

    first_term = F.when(even, x * F.exp(-x)).otherwise(F.sqrt(x) * F.exp(-x) * (2.0 / math.sqrt(math.pi)))
    steps = F.when(few, F.when(even, k / 2 - 1).otherwise((k - 1) / 2)).otherwise(0).cast("int")
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first_term.alias("term"), F.lit(0.0).alias("total"), F.when(even, 1.0).otherwise(0.5).alias("a")),
        lambda acc, i: F.struct((acc.term * x / (acc.a + 1.0)).alias("term"), (acc.total + acc.term).alias("total"), (acc.a + 1.0).alias("a")),
        lambda acc: acc.total,
    )
    first = F.when(F.abs(eta) < 0.2, _polynomial(eta, _FIRST_TERM)).otherwise(1.0 / step - 1.0 / eta)
    second = F.when(F.abs(eta) < 0.2, _polynomial(eta, _SECOND_TERM)).otherwise(F.pow(eta, F.lit(-3)) - F.pow(step, F.lit(-3)) - F.pow(step, F.lit(-2)) - 1.0 / (12.0 * step))
    main = F.when(eta >= 0, erfc / 2.0).otherwise(1.0 - erfc / 2.0)
    uniform = main + F.exp(-a * half_square) / F.sqrt(2.0 * math.pi * a) * (first + second / a)
    tail = F.when(few, F.when(even, F.exp(-x)).otherwise(erfc) + summed).otherwise(uniform)
    bounded = F.when((k <= 0) | (x <= 0), 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
    return out.select(*df.columns, bounded.alias(output))
