"""Tail probabilities of the normal, chi-square, t and F distributions.

They act on report rows (a handful of sufficient statistics per test), never on data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_sf(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_reg(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_reg(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def _guarded(fn):
    def call(*args):
        if any(a is None or math.isnan(a) for a in args):
            return None
        return float(fn(*args))
    return call


def chi2_p(x: Column, df: Column) -> Column:
    return F.udf(_guarded(chi2_sf), "double", useArrow=False)(x, df)


def t_p(t: Column, df: Column) -> Column:
    return F.udf(_guarded(t_two_sided), "double", useArrow=False)(t, df)


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    return F.udf(_guarded(f_sf), "double", useArrow=False)(f, df1, df2)
