"""Rates and intervals as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def rate(n: Column, d: Column, empty: float | None = 0.0) -> Column:
    """n / d, and `empty` where d is 0."""
    return F.when(d != 0, n / d).otherwise(F.lit(empty).cast("double"))


def wilson(passed: Column, total: Column) -> Column:
    """The 95 % Wilson interval as an array of two, clamped to [0, 1]; null where total is 0."""
    n, z2 = total.cast("double"), Z95 * Z95
    p = passed / n
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(total > 0, F.array(F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)))


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(c).cast("long")
