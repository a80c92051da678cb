"""Distribution functions that neither Spark nor the installed libraries offer, as numbers and as Columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail, as published by G. West (2005).
HART_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def norm_cdf_col(x: Column) -> Column:
    """Normal distribution function as a built-in expression, right to 14 digits; null for null."""
    z = F.abs(x)

    def poly(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * z + F.lit(k)
        return out

    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, F.exp(-z * z / 2) * poly(HART_P) / poly(HART_Q))
    far = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + F.lit(0.65)))))
    tail = tail.otherwise(F.exp(-z * z / 2) / far / F.lit(2.506628274631))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    """The same as SQL text."""

    def poly(c: tuple[float, ...]) -> str:
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * abs({x}) + {k!r})"
        return out

    z = f"abs({x})"
    far = f"({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65)))))"
    tail = f"(case when {z} > 37 then 0.0 when {z} < 7.07106781186547 then exp(-({x}) * ({x}) / 2) * {poly(HART_P)} / {poly(HART_Q)} else exp(-({x}) * ({x}) / 2) / {far} / 2.506628274631 end)"
    return f"(case when {x} > 0 then 1 - {tail} else {tail} end)"


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(x: float, df: float) -> float:
    if math.isnan(x):
        return math.nan
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
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
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return math.nan if math.isnan(x) else gamma_upper(df / 2, x / 2)


def tail(cdf: float, alternative: str) -> float:
    """p-value from the distribution function at the statistic, for a symmetric distribution."""
    if alternative == "two-sided":
        return 2 * min(cdf, 1 - cdf)
    if alternative not in ("less", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}")
    return cdf if alternative == "less" else 1 - cdf


def p_value_col(statistic: Column, df: Column | None, alternative: str, kind: str) -> Column:
    """p-values of result rows (one a test, so few): kind t, chi2 or normal. Null statistics give 1, as a test
    without variance can't reject."""

    def one(x: float, k: float) -> float:
        if x is None or math.isnan(x):
            return 1.0
        if kind == "chi2":
            return chi2_sf(x, k)
        return tail(t_cdf(x, k) if kind == "t" else norm_cdf(x), alternative)

    @F.pandas_udf("double")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(x, k, strict=True)], dtype=float)

    return run(statistic.cast("double"), (F.lit(0.0) if df is None else df).cast("double"))
