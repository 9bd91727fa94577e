"""Tail probabilities of Student's t and of the F distribution, for small result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _stirling_rest(x: float) -> float:
    """What Stirling's formula for lgamma(x) leaves out, for large x."""
    return (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x


def _log_beta(a: float, b: float) -> float:
    """Logarithm of the beta function; large arguments do not cancel each other."""
    small, large = min(a, b), max(a, b)
    if large < 50:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    rest = _stirling_rest(large) - _stirling_rest(a + b)
    gained = (large - 0.5) * math.log1p(small / large) + small * math.log(a + b) - small
    return math.lgamma(small) - gained + rest


def _beta_tail(x: float, y: float, a: float, b: float) -> float:
    """Regularised incomplete beta function at x = 1 - y, by its continued fraction (modified Lentz)."""
    if math.isnan(x):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(y, x, b, a)
    tiny = 1e-300
    log_x, log_y = (math.log1p(-q) if q < 0.5 else math.log(p) for p, q in ((x, y), (y, x)))
    scale = math.exp(a * log_x + b * log_y - _log_beta(a, b))
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            change = c * d
            value *= change
        if abs(change - 1.0) < 4e-16:
            return scale * value / a
    return math.nan  # not converged


def f_tail_value(f: float, df1: float, df2: float) -> float:
    whole = df2 + df1 * f
    return _beta_tail(df2 / whole, df1 * f / whole, df2 / 2.0, df1 / 2.0)


def t_two_sided_value(t: float, df: float) -> float:
    if df >= 1e6:  # there the fraction cancels; this normal form is off by about 1 / df ** 2
        return math.erfc(math.sqrt((df - 0.5) * math.log1p(t * t / df) / 2.0))
    whole = df + t * t
    return _beta_tail(df / whole, t * t / whole, df / 2.0, 0.5)


def _known(value: float) -> float | None:
    return None if math.isnan(value) else value


@F.pandas_udf(DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([_known(f_tail_value(*row)) for row in zip(f, df1, df2)], dtype="Float64")


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_known(t_two_sided_value(*row)) for row in zip(t, df)], dtype="Float64")


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """Chance of an F value this large or larger."""
    return _f_tail(f.cast("double"), df1.cast("double"), df2.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    """Chance of a t value this far from 0 or farther."""
    return _t_two_sided(t.cast("double"), df.cast("double"))
