"""Column expressions of the normal and the chi-square distribution.

Spark has no error function, so the distribution function is summed from its
odd-power series

    cdf(z) = 1/2 + pdf(z) * (z + z^3/3 + z^5/(3*5) + z^7/(3*5*7) + ...)

These are meant for result tables (one row per experiment), not for fact tables.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

SERIES_TERMS = 120
# Beyond this the tail is below double precision of 1; the series no longer converges
# within SERIES_TERMS, so the limit value is returned instead.
TAIL = 8.0
BISECTIONS = 60
GAMMA_TERMS = 200
# Half a statistic beyond which no tail is left in double precision for up to thousands of degrees.
LARGEST_HALF = 1e6


def normal_cdf(z: Column) -> Column:
    z = z.cast("double")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.struct(z.alias("sum"), z.alias("term")),
        lambda state, i: _series_step(state, i, z),
        lambda state: state["sum"],
    )
    density = F.exp(z * z * -0.5) / F.lit(math.sqrt(2 * math.pi))
    return (
        F.when(z > TAIL, F.lit(1.0))
        .when(z < -TAIL, F.lit(0.0))
        .otherwise(F.lit(0.5) + density * series)
    )


def _series_step(state: Column, i: Column, z: Column) -> Column:
    term = state["term"] * z * z / (i * 2 + 1)
    return F.struct((state["sum"] + term).alias("sum"), term.alias("term"))


def two_sided_p(z: Column) -> Column:
    return (F.lit(1.0) - normal_cdf(F.abs(z))) * 2


def chi_square_p(statistic: Column) -> Column:
    """Survival function of the chi-square distribution with one degree of freedom."""
    return two_sided_p(F.sqrt(statistic))


def _log_gamma_of_half(n: Column) -> Column:
    """ln Gamma(n / 2) for a whole ``n`` of 1 or more, by its recurrence from 1/2 or 1."""
    begin = F.when(n % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    steps = (n / 2 - begin).cast("int")
    factors = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        factors, F.when(n % 2 == 0, F.lit(0.0)).otherwise(F.lit(math.log(math.pi) / 2)), lambda total, i: total + F.log(begin + i)
    )


def _lower_series(a: Column, x: Column, terms: int) -> Column:
    """1/a + x/(a(a+1)) + x^2/(a(a+1)(a+2)) + ..., which converges well where x < a + 1."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct((1 / a).alias("sum"), (1 / a).alias("term")),
        lambda state, i: _ratio_step(state, x / (a + i)),
        lambda state: state["sum"],
    )


def _ratio_step(state: Column, ratio: Column) -> Column:
    term = state["term"] * ratio
    return F.struct((state["sum"] + term).alias("sum"), term.alias("term"))


def _upper_fraction(a: Column, x: Column, terms: int) -> Column:
    """1/(x+1-a- 1(1-a)/(x+3-a- 2(2-a)/(x+5-a- ...))), which converges well where x >= a + 1."""
    # From the innermost denominator outwards.
    return 1 / F.aggregate(
        F.sequence(F.lit(terms), F.lit(1), F.lit(-1)),
        x + 2 * terms + 1 - a,
        lambda inner, i: x + 2 * i - 1 - a - i * (i - a) / inner,
    )


def chi_square_tail(statistic: Column, degrees: Column) -> Column:
    """Survival function of the chi-square distribution with any whole number of degrees.

    This is the regularised upper incomplete gamma function of (degrees / 2, statistic / 2),
    by its series below the mean and its continued fraction above.  NULL where there is no
    degree of freedom.
    """
    n = degrees.cast("int")
    a, x = n.cast("double") / 2, statistic.cast("double") / 2
    scale = F.exp(a * F.log(x) - x - _log_gamma_of_half(n))
    tail = F.when(x < a + 1, 1 - scale * _lower_series(a, x, GAMMA_TERMS)).otherwise(scale * _upper_fraction(a, x, GAMMA_TERMS))
    # An infinite statistic, as of users in an arm that was not planned, has no tail.
    return F.when(n < 1, None).when(x <= 0, F.lit(1.0)).when(x > LARGEST_HALF, F.lit(0.0)).otherwise(tail)


def normal_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


# Coefficients of Acklam's rational approximation of the normal quantile, highest
# power first.
CENTRAL_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRAL_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_BELOW = 0.02425


def normal_quantile_of(probability: Column) -> Column:
    """Inverse of ``normal_cdf``, of a column: a rational approximation and a Newton step.

    NULL outside of (0, 1).
    """
    p = probability.cast("double")

    def polynomial(coefficients: tuple[float, ...], at: Column) -> Column:
        total = F.lit(coefficients[0])
        for c in coefficients[1:]:
            total = total * at + c
        return total

    def tail(q: Column) -> Column:
        r = F.sqrt(F.log(q) * -2)
        return polynomial(TAIL_TOP, r) / polynomial(TAIL_BOTTOM, r)

    middle = p - 0.5
    rough = (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < TAIL_BELOW, tail(p))
        .when(p > 1 - TAIL_BELOW, -tail(1 - p))
        .otherwise(middle * polynomial(CENTRAL_TOP, middle * middle) / polynomial(CENTRAL_BOTTOM, middle * middle))
    )
    # Computed once, as the step uses it several times.
    return F.transform(F.array(rough), lambda z: z - (normal_cdf(z) - p) * F.exp(z * z / 2) * math.sqrt(2 * math.pi))[0]


def effect_size(baseline: Column, treatment: Column) -> Column:
    """Difference of two proportions on the arcsine scale; NULL outside [0, 1]."""
    def angle(p: Column) -> Column:
        return F.when(p.between(0, 1), F.asin(F.sqrt(p)) * 2)

    return angle(baseline) - angle(treatment)


def sample_size(effect: Column, alpha: float | Column, power: float | Column) -> Column:
    """Users per arm at which a two-sided two-sample z-test reaches ``power``.

    Both may differ from row to row.  Both tails count, so the usual closed form (one tail) is
    only an upper bound; the root is bisected below it.
    """
    critical = normal_quantile_of(1 - alpha / 2) if isinstance(alpha, Column) else F.lit(normal_quantile(1 - alpha / 2))
    planned = normal_quantile_of(power) if isinstance(power, Column) else F.lit(normal_quantile(power))
    if isinstance(alpha, Column) or isinstance(power, Column):
        both = F.struct(critical.alias("critical"), planned.alias("planned"))
        return F.transform(F.array(both), lambda z: _sample_size(effect, z["critical"], z["planned"], power))[0]
    return _sample_size(effect, critical, planned, power)


def _sample_size(effect: Column, critical: Column, planned: Column, power: float | Column) -> Column:
    target = critical + planned
    ceiling = F.try_divide(target * target * 2, effect * effect)

    def reached(n: Column) -> Column:
        shift = F.abs(effect) * F.sqrt(n / 2)
        return normal_cdf(shift - critical) + normal_cdf(-shift - critical) >= power

    def halve(bounds: Column, _: Column) -> Column:
        middle = (bounds["low"] + bounds["high"]) / 2
        enough = reached(middle)
        return F.struct(
            F.when(enough, bounds["low"]).otherwise(middle).alias("low"),
            F.when(enough, middle).otherwise(bounds["high"]).alias("high"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECTIONS)),
        F.struct(F.lit(0.0).alias("low"), ceiling.alias("high")),
        halve,
        lambda bounds: bounds["high"],
    )
