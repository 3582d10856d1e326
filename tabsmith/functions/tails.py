"""Tail probabilities of t, F, chi-square and Kolmogorov statistics.

They are needed for a few aggregated rows per result, so a small Arrow-batched UDF over those
rows is enough; raw rows never pass through it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _lentz(step, limit: int = 20_000) -> float:
    """Continued fraction b0 + a1/(b1 + a2/(b2 + ...)); step(k) gives (a_k, b_k)."""
    _, b0 = step(0)
    f = b0 if b0 != 0.0 else _TINY
    c, d = f, 0.0
    for k in range(1, limit):
        a, b = step(k)
        d = b + a * d
        d = 1.0 / (d if d != 0.0 else _TINY)
        c = b + a / c
        c = c if c != 0.0 else _TINY
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return f
    if abs(c * d - 1.0) < 1e-9:
        return f
    raise ArithmeticError("the continued fraction did not converge")


def reg_inc_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - reg_inc_beta(1.0 - x, b, a)

    def step(k: int):
        if k == 0:
            return 0.0, 1.0
        m, odd = divmod(k, 2)
        if odd:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return num, 1.0

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    return front / a / _lentz(step)


def reg_upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total

    def step(k: int):
        if k == 0:
            return 0.0, x + 1.0 - s
        return -k * (k - s), x + 2 * k + 1.0 - s

    return front / _lentz(step)


#: Above this many degrees of freedom the limiting distribution is closer than the gamma functions' rounding.
LIMIT = 1e7


def t_two_sided(t: float, df: float) -> float:
    if df > LIMIT:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return reg_inc_beta(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0.0:
        return 1.0
    if d2 > LIMIT:
        return chi2_upper(d1 * f, d1)
    return reg_inc_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    if df > LIMIT:  # the cube root is nearly normal
        z = ((x / df) ** (1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / math.sqrt(2.0 / (9.0 * df))
        return 0.5 * math.erfc(z / math.sqrt(2.0))
    return reg_upper_gamma(df / 2.0, x / 2.0)


def kolmogorov_upper(x: float) -> float:
    """Survival function of the Kolmogorov distribution."""
    if x < 1e-3:
        return 1.0
    if x < 0.3:
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return max(0.0, 1.0 - math.sqrt(2 * math.pi) / x * s)
    s = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * s))


def _rowwise(fn, *cols: pd.Series) -> pd.Series:
    out = [
        fn(*map(float, v)) if all(x is not None and np.isfinite(x) for x in v) else None
        for v in zip(*cols)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_upper, x, df)


@F.pandas_udf(T.DoubleType())
def kolmogorov_p_value(x: pd.Series) -> pd.Series:
    return _rowwise(kolmogorov_upper, x)
