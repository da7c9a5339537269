"""Array column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union_ignoring_case(a: Column, b: Column) -> Column:
    """Both arrays in order; of spellings that differ in case only, the first stays."""
    start = F.filter(a, lambda x: F.lit(False))
    seen = lambda kept, x: F.exists(kept, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(F.concat(a, b), start, lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.array_append(kept, x)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all distinct elements; `empty` where both arrays are empty."""
    everything = F.size(F.array_union(a, b))
    return F.when(everything == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / everything)
