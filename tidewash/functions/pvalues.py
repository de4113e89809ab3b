"""Tail probabilities for the few rows of a finished report."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F, types as T


def normal_tail(z: float) -> float:
    """Probability of a standard normal above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_tail(x: float, dof: float) -> float | None:
    """Probability of a chi-squared variable above ``x`` (upper incomplete gamma).

    None if an argument is not a number.
    """
    if math.isnan(x) or math.isnan(dof):
        return None
    if math.isinf(x):
        return 0.0 if x > 0 else 1.0
    if dof <= 0 or x <= 0:
        return 1.0
    a, half = dof / 2.0, x / 2.0
    scale = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        step = a
        while abs(term) > abs(total) * 1e-16:
            step += 1.0
            term *= half / step
            total += term
        return max(0.0, 1.0 - scale * total)
    # Continued fraction, evaluated forwards.
    tiny = 1e-300
    b = half + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    fraction = d
    i = 1
    while True:
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        fraction *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return min(1.0, scale * fraction)
        i += 1


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    fraction = d
    m = 1
    while True:
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d = 1.0 / ((1.0 + even * d) or tiny)
        c = (1.0 + even / c) or tiny
        fraction *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d = 1.0 / ((1.0 + odd * d) or tiny)
        c = (1.0 + odd / c) or tiny
        fraction *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return fraction
        m += 1


def beta_share(a: float, b: float, x: float) -> float | None:
    """The regularised incomplete beta function; None if an argument is not a number."""
    if math.isnan(a) or math.isnan(b) or math.isnan(x):
        return None
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a Pearson correlation over ``n`` pairs; None for NaN."""
    if math.isnan(r):
        return None
    if n < 3:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    dof = n - 2
    t2 = r * r * dof / (1.0 - r * r)
    return beta_share(dof / 2.0, 0.5, dof / (dof + t2))


EXACT_SMALL = 8


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float | None:
    """Two-sided p-value of the Mann-Whitney statistic ``u`` of the first sample.

    ``ties`` is the sum of t cubed minus t over the tied runs. Without ties
    and with a sample of at most eight the exact law is used, whatever the size
    of the other sample, else the tie-corrected normal law with continuity
    correction. None if ``u`` or ``ties`` is not a number.
    """
    if math.isnan(u) or math.isnan(ties):
        return None
    large = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= EXACT_SMALL:
        return min(1.0, 2.0 * _exact_tail(math.ceil(large), min(n1, n2), max(n1, n2)))
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0
    z = (large - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, max(0.0, 2.0 * normal_tail(z)))


@lru_cache(maxsize=EXACT_SMALL + 1)
def _partition_numerator(parts: int) -> tuple[int, list[int]]:
    """The period L and the coefficients of (1 - x^L)^(parts + 1) / ((1 - x) prod (1 - x^i))."""
    period = math.lcm(*range(1, parts + 1)) if parts else 1
    series = [1]
    for step in (1, *range(1, parts + 1)):
        # Times 1 + x^step + x^(2 step) + ... + x^(period - step), by a running sum.
        longer = series + [0] * (period - step)
        for at in range(step, len(longer)):
            longer[at] += longer[at - step]
        for at in range(len(longer) - 1, period - 1, -1):
            longer[at] -= longer[at - period]
        series = longer
    return period, series


def _partitions_up_to(most: int, parts: int) -> int:
    """How many partitions into at most ``parts`` parts have a sum of at most ``most``.

    The count is a polynomial of degree ``parts`` for each remainder of ``most``
    by the least common multiple of the part sizes, so the work does not grow
    with ``most``.
    """
    if most < 0:
        return 0
    period, series = _partition_numerator(parts)
    return sum(
        series[at] * math.comb((most - at) // period + parts, parts)
        for at in range(most % period, min(most, len(series) - 1) + 1, period)
    )


def _exact_tail(u: int, small: int, large: int) -> float:
    """P(U >= u) without ties.

    By symmetry that is the share of partitions into at most ``small`` parts of
    at most ``large`` each with a sum of at most ``small * large - u``; parts that
    are too large are taken out by inclusion and exclusion.
    """
    most = small * large - u
    ways = 0
    for count in range(small + 1):
        for chosen in combinations(range(1, small + 1), count):
            rest = most - count * large - sum(chosen)
            ways += (-1) ** count * _partitions_up_to(rest, small)
    return ways / math.comb(small + large, small)


@F.pandas_udf(T.DoubleType())
def chi2_p_column(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, dof, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p_column(
    u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series
) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(a) else mann_whitney_p(a, int(b), int(c), d)
            for a, b, c, d in zip(u, n1, n2, ties, strict=True)
        ],
        dtype=float,
    )
