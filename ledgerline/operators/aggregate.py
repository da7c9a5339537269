"""Aggregations: gap-filled series, matrices, histograms, funnels, shares and rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import RULES


def count_where(**predicates: Column) -> list[Column]:
    """One conditional count per name, all in one pass."""
    return [F.count_if(p).alias(name) for name, p in predicates.items()]


def week_of_year(day: Column) -> Column:
    """Weeks from the year's first Monday, 00 before it."""
    return F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")


def fill_days(counts: DataFrame, day: str, first: str, last: str, **defaults) -> DataFrame:
    """Every day from first to last, with defaults where counts has no row."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(day))
    joined = spine.join(counts.withColumn(day, F.to_date(day)), day, "left")
    return joined.select(day, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def matrix(rows: DataFrame, row: str, column: str, n: int, missing: str = "-") -> DataFrame:
    """Counts of the n most frequent rows by the n most frequent columns."""
    rows = rows.select(F.coalesce(row, F.lit(missing)).alias(row), F.coalesce(column, F.lit(missing)).alias(column))
    keep_rows, keep_columns = top_values(rows, row, n).drop("n"), top_values(rows, column, n).drop("n")
    return rows.groupBy(row, column).agg(F.count("*").alias("n")).join(F.broadcast(keep_rows), row, "left_semi").join(F.broadcast(keep_columns), column, "left_semi")


def equi_width(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """bucket, low, high, n over the value's range; the last bucket is closed."""
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.when(width == 0, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("lo")) / width))).cast("int")
    # One row of bounds.
    counted = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(bucket.alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select("bucket", (F.col("lo") + F.col("bucket") * width).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("high"), "n")


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, n: overlapping predicates counted in one pass, as rows."""
    counted = rows.agg(*count_where(**stages))
    pairs = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("n")) for i, s in enumerate(stages)))
    return counted.select(F.inline(pairs))


def daily_outer(left: DataFrame, right: DataFrame, key: str, **defaults) -> DataFrame:
    """Two series side by side, with defaults where one has no row."""
    joined = left.join(right, key, "full")
    return joined.select(key, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def capped_sums(rows: DataFrame, key: str, category: str, amount: Column, caps: dict[str, float], default: float) -> DataFrame:
    """key, score: amounts summed by category, each up to its cap."""
    cap = reduce(lambda c, kv: F.when(F.col(category) == kv[0], kv[1]).otherwise(c), caps.items(), F.lit(default))
    by_category = rows.groupBy(key, category).agg(F.sum(amount).alias("amount"))
    return by_category.groupBy(key).agg(F.sum(F.least("amount", cap)).alias("score"))


def minimum_sample(value: Column, n: Column, least: int) -> Column:
    """value, or null where it rests on fewer than least rows."""
    return F.when(n >= least, value)


def regression_gate(before: DataFrame, after: DataFrame, key: str, metric: str, drop: float, lower_is_better: Column) -> DataFrame:
    """Joins two runs' metrics; regressed where the relative change for the worse is above drop."""
    joined = before.select(key, F.col(metric).alias("before")).join(after.select(key, F.col(metric).alias("after")), key)
    change = F.try_divide(F.col("after") - F.col("before"), F.abs("before"))
    return joined.withColumn("change", change).withColumn("regressed", F.coalesce(F.when(lower_is_better, change > drop).otherwise(-change > drop), F.lit(False)))


def trailing_share(rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Each row's share of its keys' positive total."""
    positive = F.sum(F.greatest(amount, F.lit(0.0))).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.try_divide(F.col(amount), positive))


def index_percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """keys, n and for each name of wanted the value at an index rule's place (numbers.RULES) among the key's non-null values.

    Equal values are counted before the shuffle, and a running count over a key's distinct values finds the
    places, so no key's values are ever one row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    key = Window.partitionBy(*keys)
    placed = counts.withColumn("_n", F.sum("_c").over(key)).withColumn("_upto", F.sum("_c").over(key.orderBy("_v")))
    here = lambda p, rule: RULES[rule](F.col("_n"), F.lit(p)).between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1)
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *(F.max(F.when(here(p, rule), F.col("_v"))).alias(name) for name, (p, rule) in wanted.items()))
