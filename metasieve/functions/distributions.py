"""Student's t and chi-squared distributions without further libraries: plain numbers, columns and SQL functions."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    tail = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0
    return tail if t >= 0 else 1 - tail


@lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    """The quantile of Student's t, by bisection."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_sf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    """P(X > x): a series below the mean, a continued fraction above."""
    if x <= 0 or df <= 0:
        return 1.0
    a, y = df / 2, x / 2
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = y + 1 - a, 1e300, 1 / (y + 1 - a)
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


@F.pandas_udf(DoubleType())
def t_sf_col(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_sf(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def chi2_sf_col(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_sf(float(a), float(b)) for a, b in zip(x, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def t_ppf_col(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_ppf(float(a), float(b)) for a, b in zip(p, df, strict=True)], dtype=float)


#: Degrees of freedom whose critical values are literals in the plan. Beyond, the expansion around the normal quantile has
#: terms enough to agree with them to the ten digits that they have.
TABLE_DF = 200
_Z = 1.959963984540054


@lru_cache(maxsize=1)
def critical_values() -> tuple[float, ...]:
    """Two-sided 95 % critical values of t for 1 to TABLE_DF degrees of freedom."""
    return tuple(round(t_ppf(0.975, k), 10) for k in range(1, TABLE_DF + 1))


def t_critical(df: Column) -> Column:
    """The 95 % two-sided critical value, in the JVM: a literal array, then the expansion; null below 1."""
    d = df.cast("double")
    z, inv = F.lit(_Z), 1 / F.nullif(d, F.lit(0.0))
    z3, z5 = _Z**3, _Z**5
    z7, z9 = _Z**7, _Z**9
    terms = ((z3 + _Z) / 4, (5 * z5 + 16 * z3 + 3 * _Z) / 96, (3 * z7 + 19 * z5 + 17 * z3 - 15 * _Z) / 384, (79 * z9 + 776 * z7 + 1482 * z5 - 1920 * z3 - 945 * _Z) / 92160)
    beyond = z + sum((F.lit(t) * F.pow(inv, F.lit(k)) for k, t in enumerate(terms, 1)), F.lit(0.0))
    listed = F.get(F.array(*map(F.lit, critical_values())), df.cast("int") - 1)
    return F.when(d >= 1, F.when(d <= TABLE_DF, listed).otherwise(beyond))


def register(spark: SparkSession) -> None:
    """t_sf, t_ppf and chi2_sf for SQL texts."""
    for name, f in (("t_sf", t_sf_col), ("t_ppf", t_ppf_col), ("chi2_sf", chi2_sf_col)):
        spark.udf.register(name, f)
