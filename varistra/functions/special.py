"""Tail probabilities without SciPy: Student's t, chi-square, normal, hypergeometric (Fisher)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided Fisher exact test of the table [[a, b], [c, d]]: at least a in its cell."""
    n, row, col = a + b + c + d, a + b, a + c
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return min(1.0, sum(math.exp(choose(col, k) + choose(n - col, row - k) - choose(n, row)) for k in range(a, min(row, col) + 1) if row - k <= n - col))


def _series(fn, *args):
    import pandas as pd

    return pd.Series([None if any(x is None or np.isnan(x) for x in xs) else fn(*xs) for xs in zip(*args)], dtype="float64")


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; null where either is null."""
    return F.pandas_udf(lambda x, y: _series(t_two_sided, x, y), "double")(t.cast("double"), df.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    return F.pandas_udf(lambda a, b: _series(lambda x, k: gammaincc(k / 2, x / 2), a, b), "double")(x.cast("double"), df.cast("double"))


def normal_p(z: Column) -> Column:
    return F.pandas_udf(lambda a: _series(lambda x: math.erfc(abs(x) / math.sqrt(2)), a), "double")(z.cast("double"))


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.pandas_udf(lambda *x: _series(lambda *y: fisher_greater(*map(int, y)), *x), "double")(*(v.cast("double") for v in (a, b, c, d)))
