"""Tail probabilities for the few rows that tests end in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_upper(z: float) -> float:
    """P(Z > z) of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    def guard(v: float) -> float:
        return v if abs(v) > 1e-300 else 1e-300

    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / guard(1.0 + term * d)
            c = guard(1.0 + term / c)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def two_sided_normal_p(z: Column) -> Column:
    """Two-sided p-value; null where z is."""

    @F.pandas_udf("double")
    def p(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(lambda x: None if x is None or math.isnan(x) else 2.0 * normal_upper(abs(x))).astype("float64")

    return p(z.cast("double"))


def upper_normal_p(z: Column) -> Column:
    """One-sided p-value; null where z is."""

    @F.pandas_udf("double")
    def p(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(lambda x: None if x is None or math.isnan(x) else normal_upper(x)).astype("float64")

    return p(z.cast("double"))


def two_sided_t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null where t or df is."""

    @F.pandas_udf("double")
    def p(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in frames:
            yield pd.Series(
                [None if math.isnan(x) or math.isnan(n) or n <= 0 else t_two_sided(x, n) for x, n in zip(a, b, strict=True)],
                dtype="float64"
            )

    return p(t.cast("double"), df.cast("double"))
