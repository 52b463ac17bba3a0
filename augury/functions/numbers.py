"""Ratios, moments and rounding shared by the analyses; sums stay exact ints until the last division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def variance(squares: Column, total: Column, n: Column, ddof: int) -> Column:
    """Variance from the sum of squares, the sum and the count; null where n is at most ddof."""
    s, m = total.cast("double"), n.cast("double")
    return F.when(n > ddof, F.greatest((squares.cast("double") - s * s / m) / F.when(n > ddof, m - F.lit(float(ddof))), F.lit(0.0)))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def human(n: Column) -> Column:
    """A count in short form: ``1.2M`` from a million, ``3K`` from a thousand, ties to even; plain below."""
    short = lambda by, digits, unit: F.format_string(f"%.{digits}f{unit}", F.bround(n / float(by), digits))
    return F.when(n >= 1_000_000, short(10**6, 1, "M")).when(n >= 1_000, short(10**3, 0, "K")).otherwise(n.cast("string"))
