"""Join of names within a few edits, without lost pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(c: Column, k: int) -> Column:
    """The string and what is left of it when up to k characters go; distinct."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    one = lambda s: F.when(F.length(s) > 0, without(s)).otherwise(F.array().cast("array<string>"))
    found = layer = F.array(c)
    for _ in range(k):
        layer = F.array_distinct(F.flatten(F.transform(layer, one)))
        found = F.array_union(found, layer)
    return found


def within_edits(left: DataFrame, right: DataFrame, left_name: str, right_name: str, k: int = 1) -> DataFrame:
    """left_name, right_name, edits of all distinct names of both sides that are within k edits (insertions, deletions, substitutions).

    Two such names share what is left of each after k deletions at most, so they meet by an equi-join on their deletion
    neighbourhoods, and what shares a key is within 2k edits already: a prefix that all names have makes no pairs. A name of n characters
    has about n^k / k! keys, so k is small. Names are compared once however many rows bear them; nulls meet nothing.
    """
    a = left.select(F.col(left_name).alias("_a")).filter("_a is not null").distinct()
    b = right.select(F.col(right_name).alias("_b")).filter("_b is not null").distinct()
    key = lambda df, c: df.select(c, F.explode(deletions(F.col(c), k)).alias("_k")).select(c, F.xxhash64("_k").alias("_k"))
    met = key(a, "_a").join(key(b, "_b"), "_k").filter(F.abs(F.length("_a") - F.length("_b")) <= k).select("_a", "_b").distinct()
    scored = met.withColumn("edits", F.levenshtein("_a", "_b", k)).filter("edits >= 0")
    return scored.select(F.col("_a").alias(left_name), F.col("_b").alias(right_name), "edits")
