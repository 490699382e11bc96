"""Tails and quantiles of the t, F, chi-square and normal distributions, and columns of them for aggregated rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def t_quantile(p: float, df: float) -> float:
    """t with P(T < t) = p, by bisection."""
    if p == 0.5:
        return 0.0
    want, low, high = 2 * min(p, 1 - p), 0.0, 1.0
    while t_two_sided(high, df) > want:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > want else (low, mid)
    return math.copysign((low + high) / 2, p - 0.5)


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_tail, f, d1, d2)


@F.pandas_udf(DoubleType())
def _t_q(p: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_quantile, p, df)


@F.pandas_udf(DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return _each(normal_two_sided, z)


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _f_p(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_critical(p: Column, df: Column) -> Column:
    return _t_q(p.cast("double"), df.cast("double"))


def z_p_value(z: Column) -> Column:
    return _z_p(z.cast("double"))
