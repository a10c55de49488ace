"""Statistical functions as Column arithmetic (no Python in the hot path)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the double-precision rational approximation to the normal
# tail (Hart's 5666 algorithm as given by G. West, 2005).
TAIL_NUMERATOR = [
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
TAIL_DENOMINATOR = [
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
TAIL_SWITCH = 7.07106781186547
TAIL_END = 37.0
SQRT_TWO_PI = 2.506628274631


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_upper_tail(z: Column) -> Column:
    """P(Z > |z|)."""
    a = F.abs(z)
    density = F.exp(-a * a / 2)
    near = density * _horner(TAIL_NUMERATOR, a) / _horner(TAIL_DENOMINATOR, a)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = density / fraction / F.lit(SQRT_TWO_PI)
    return F.when(a > TAIL_END, 0.0).when(a < TAIL_SWITCH, near).otherwise(far)


def normal_cdf(z: Column) -> Column:
    return F.when(z > 0, 1 - normal_upper_tail(z)).otherwise(normal_upper_tail(z))


def two_sided_p(z: Column) -> Column:
    return 2 * normal_upper_tail(z)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def student_t_quantile(p: float, dof: Column) -> Column:
    """Cornish-Fisher expansion of the Student t quantile; accurate to ~1e-7 for dof >= 100."""
    z = normal_quantile(p)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    out = F.lit(z)
    power = F.lit(1.0)
    for t in terms:
        power = power * dof
        out = out + F.lit(t) / power
    return out


def student_t_to_z(t: Column, dof: Column) -> Column:
    """Normal score with (nearly) the same two-sided tail as t; Wallace-type approximation."""
    scale = (8 * dof + 1) / (8 * dof + 3)
    return scale * F.sqrt(dof * F.log1p(t * t / dof))


def clip_probability(p: Column, lo: float = 0.01, hi: float = 0.99) -> Column:
    return F.least(F.greatest(p, F.lit(lo)), F.lit(hi))


def numeric_or_zero(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))


def haldane_odds_ratio(a: Column, b: Column, c: Column, d: Column, add: float = 0.5) -> dict[str, Column]:
    """Corrected odds ratio of a 2x2 table with its Wald interval."""
    a, b, c, d = (x + F.lit(add) for x in (a, b, c, d))
    ratio = (a * d) / (b * c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {
        "or_unadjusted": ratio,
        "or_ci_low": F.exp(F.ln(ratio) - 1.96 * se),
        "or_ci_high": F.exp(F.ln(ratio) + 1.96 * se),
    }


def _stirling_error(n: float) -> float:
    """log n! beyond Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - math.log(2 * math.pi) / 2 if n else 0.0
    r = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - r / 1680) * r) * r) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) - x + mean, without cancellation near the mean."""
    e = (x - mean) / mean
    if abs(e) < 1e-3:
        return mean * e * e * (1 / 2 - e * (1 / 6 - e * (1 / 12 - e * (1 / 20 - e / 30))))
    return mean * ((1 + e) * math.log1p(e) - e)


def log_binomial(x: float, n: float, p: float) -> float:
    """Log probability of x successes in n trials, 0 < p < 1, by the saddle-point expansion (C. Loader, 2000)."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    apart = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return apart + math.log(n / (2 * math.pi * x * (n - x))) / 2


def fisher_two_sided(a: float, b: float, c: float, d: float) -> float:
    """Two-sided exact p of [[a, b], [c, d]]: the tables no likelier than the observed one.

    Probabilities have a closed form. On the observed table's side of the mode all tables further out
    count; on the other side a bisection finds the first that does. Each tail is summed outwards from
    there by the ratio of neighbours until the terms vanish: a number of steps that falls with the
    distance from the mode and never exceeds some standard deviations, however large the counts.
    """
    row, col, n = a + b, a + c, a + b + c + d
    rest, lo, hi = n - row - col, max(0.0, a - d), min(row, col)
    if lo >= hi:
        return 1.0
    p = col / n

    def log_p(x: float) -> float:
        return log_binomial(x, row, p) + log_binomial(col - x, n - row, p) - log_binomial(col, n, p)

    mode = min(max(math.floor((row + 1) * (col + 1) / (n + 2)), lo), hi)
    level = log_p(a)
    if a == mode or level >= log_p(mode) - 1e-7:
        return 1.0
    reach = 12 * math.sqrt(row * col * (n - row) * (n - col) / (n * n * max(n - 1, 1))) + 50

    def tail(x: float, up: bool) -> float:
        """Sum of the probabilities from x outwards, relative to that of x."""
        total, last, at = 1.0, 1.0, 0
        end = int(min(hi - x if up else x - lo, reach))
        while at < end and last > 1e-18:
            y = x + np.arange(at, min(end, at + 4096)) * (1.0 if up else -1.0)
            if up:
                ratios = (row - y) * (col - y) / ((y + 1) * (rest + y + 1))
            else:
                ratios = y * (rest + y) / ((row - y + 1) * (col - y + 1))
            terms = last * np.cumprod(ratios)
            total, last, at = total + float(terms.sum()), float(terms[-1]), at + len(y)
        return total

    up = a > mode
    within, beyond = (lo - 1, mode) if up else (hi + 1, mode)  # no likelier than observed, and likelier
    while abs(within - beyond) > 1:
        middle = (within + beyond) // 2
        if log_p(middle) <= level + 1e-7:
            within = middle
        else:
            beyond = middle
    other = math.exp(log_p(within) - level) * tail(within, not up) if lo <= within <= hi else 0.0
    return min(1.0, math.exp(level) * (tail(a, up) + other))


@F.pandas_udf(T.DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """:func:`fisher_two_sided` per row of a pair table, which has at most codes^2 rows."""
    tables = zip(*(x.to_numpy(np.float64, na_value=np.nan) for x in (a, b, c, d)))
    return pd.Series([fisher_two_sided(*map(float, t)) if not np.isnan(t).any() else None for t in tables], dtype="float64")


def kish_ess(weight: str | Column, freq: Column | None = None) -> Column:
    """Aggregate: effective sample size (sum w)^2 / sum w^2, optionally with frequencies."""
    w = F.col(weight) if isinstance(weight, str) else weight
    n = F.lit(1.0) if freq is None else freq
    return F.try_divide(F.sum(w * n) * F.sum(w * n), F.sum(w * w * n))
