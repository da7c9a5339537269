"""Numeric column helpers: rounding, clamping, decay and index-rule percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards positive infinity, as floor(x + 0.5)."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def log_scale(n: Column, top: float) -> Column:
    """0 at 0, 1 at top and above, logarithmic between."""
    return F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(float(top))))


def half_life(days: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), days / F.lit(float(half)))


def saturate(total: Column, scale: float) -> Column:
    """0 to 100, 100 * (1 - e ** (-total / scale))."""
    return 100 * (1 - F.exp(-total / F.lit(float(scale))))


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


#: Index rules of a discrete percentile in a sorted list of n values.
RULES = {
    "floor_nm1": lambda n, p: F.floor((n - 1) * p),
    "floor_n": lambda n, p: F.least(n - 1, F.floor(n * p)),
    "upper_median": lambda n, p: F.floor(n / 2),
}


def discrete_percentile(values: Column, p: float, rule: str) -> Column:
    """An aggregate: the value at the rule's index among the group's sorted non-null values.

    Holds a group's values in one row; for unbounded groups use percentile_approx.
    """
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, RULES[rule](F.size(ordered), F.lit(p)).cast("int"))
