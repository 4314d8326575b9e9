"""Tail probabilities of the normal, t, F and chi-square laws for small result tables.

Each function maps a handful of already aggregated statistics to p-values, so they run as Arrow-batched
functions over one row per test.
"""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _log_beta_front(a: float, b: float, x: float) -> float:
    return (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    frac = d
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            frac *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(_log_beta_front(a, b, x)) * frac / a


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    frac = d
    for i in range(1, 5000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        frac *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * frac


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return half if t >= 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """Value with lower-tail probability ``p``: by bisection, or from the normal quantile's expansion for many degrees."""
    if df > 1e6:
        z = NormalDist().inv_cdf(p)
        return z + (z ** 3 + z) / (4 * df)
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_sf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _vector(fn):
    def call(*columns: pd.Series) -> pd.Series:
        rows = zip(*[c.astype("float64") for c in columns])
        return pd.Series([fn(*r) if not any(np.isnan(v) for v in r) else None for r in rows], dtype="float64")
    return call


def _udf(fn, arity: int):
    vec = _vector(fn)
    if arity == 1:
        def wrapped(a: pd.Series) -> pd.Series:
            return vec(a)
    elif arity == 2:
        def wrapped(a: pd.Series, b: pd.Series) -> pd.Series:
            return vec(a, b)
    else:
        def wrapped(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return vec(a, b, c)
    return F.pandas_udf(wrapped, "double")


def normal_tail(z):
    return _udf(normal_sf, 1)(z)


def t_tail(t, df):
    return _udf(t_sf, 2)(t, df)


def f_tail(f, d1, d2):
    return _udf(f_sf, 3)(f, d1, d2)


def chi2_tail(x, df):
    return _udf(chi2_sf, 2)(x, df)


def t_critical(p, df):
    return _udf(t_quantile, 2)(p, df)
