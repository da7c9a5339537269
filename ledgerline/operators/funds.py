"""Funds and cap tables: pacing, dry powder, returns, calibration, dilution and comparables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp


def dry_powder(committed: Column, called: Column, pace: Column, months_left: Column) -> list[Column]:
    """low, mid, high of what a fund can still deploy: nothing negative, at most what is uncalled."""
    uncalled = F.greatest(committed - called, F.lit(0.0))
    expected = F.least(uncalled, pace * months_left)
    return [(0.8 * expected).alias("low"), expected.alias("mid"), F.least(uncalled, 1.2 * expected).alias("high")]


def exit_proceeds(kind: Column, position: Column, ownership: Column, price: Column, escrow: Column, mark: Column) -> Column:
    """What a position returns by the kind of its exit; escrow holds back at most a half, a mark counts for holdings."""
    held_back = 1 - clamp(F.coalesce(escrow, F.lit(0.0)), 0.0, 0.5)
    return (
        F.when(kind == "ipo", price * ownership)
        .when(kind == "acquisition", price * ownership * held_back)
        .when(kind == "bankruptcy", F.lit(0.0))
        .otherwise(F.coalesce(mark * ownership, position))
    )


def multiples(paid_in: Column, distributed: Column, value: Column, years: Column) -> list[Column]:
    """dpi, rvpi, tvpi and the yearly rate that tvpi stands for; null where nothing is paid in."""
    tvpi = F.try_divide(distributed + value, paid_in)
    rate = F.when((tvpi > 0) & (years > 0), F.pow(tvpi, 1 / years) - 1)
    return [F.try_divide(distributed, paid_in).alias("dpi"), F.try_divide(value, paid_in).alias("rvpi"), tvpi.alias("tvpi"), rate.alias("annualised")]


def bias(rows: DataFrame, bucket: list[str], predicted: str, actual: str, least: int = 3) -> DataFrame:
    """bucket, bias, n: median of actual over predicted, within 0.5 to 1.5; 1 with fewer rows than least."""
    r = rows.filter(F.col(predicted) != 0).groupBy(*bucket).agg(F.median(F.col(actual) / F.col(predicted)).alias("m"), F.count("*").alias("n"))
    return r.select(*bucket, F.when(F.col("n") >= least, clamp(F.col("m"), 0.5, 1.5)).otherwise(1.0).alias("bias"), "n")


def snapshot_steps(holdings: DataFrame, group: list[str], at: str, holder: str, share: str) -> DataFrame:
    """group, at, holder, before, after, step: each holder's change from one snapshot to the next.

    A holder that is missing from a snapshot holds 0 there: snapshots are
    numbered, and each row also stands, as what was before, in the following one.
    """
    numbered = holdings.select(*group, at).distinct().withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy(at)))
    rows = holdings.join(numbered, [*group, at]).select(*group, "i", holder, F.col(share).alias("after"))
    earlier = rows.select(*group, (F.col("i") + 1).alias("i"), holder, F.col("after").alias("before"))
    joined = rows.join(earlier, [*group, "i", holder], "full").join(numbered, [*group, "i"]).filter("i > 1")
    before, after = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    step = F.when(before == 0, "entered").when(after == 0, "exited").when(after > before, "up").when(after < before, "down").otherwise("same")
    return joined.select(*group, at, holder, before.alias("before"), after.alias("after"), step.alias("step"))


def member_changes(members: DataFrame, group: list[str], period: str, member: str, following: int) -> DataFrame:
    """group, period, member, change (joined or left) between consecutive periods of numbered membership rows.

    A member away for one period only neither left nor joined (flicker).
    """
    m = members.select(*group, period, member).distinct()
    have = lambda by: m.select(*group, (F.col(period) + by).alias(period), member)
    keys = [*group, period, member]
    periods = m.select(*group, period).distinct()
    follows = periods.join(periods.select(*group, (F.col(period) + following).alias(period)), [*group, period], "left_semi")
    joined = m.join(have(following), keys, "left_anti").join(have(2 * following), keys, "left_anti").join(follows, [*group, period], "left_semi").withColumn("change", F.lit("joined"))
    gone = have(following).join(m, keys, "left_anti").join(have(-following), keys, "left_anti").join(follows, [*group, period], "left_semi").withColumn("change", F.lit("left"))
    return joined.unionByName(gone).select(*group, period, member, "change")


def clusters(rows: DataFrame, keys: list[str], at: str, days: int, least: int) -> DataFrame:
    """Rows that anchor a window of so many days with at least `least` rows, and that number."""
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("_s").rangeBetween(0, days * 86400)
    return rows.withColumn("_s", seconds).withColumn("n", F.count("*").over(w)).filter(F.col("n") >= least).drop("_s")


def rolling_drift(rows: DataFrame, keys: list[str], month: str, category: str, months: int = 6) -> DataFrame:
    """keys, month, drift: 1 less the Jaccard overlap of the categories of the window and of the one before it.

    month is a running number of months; windows end at every month in which a key has rows. Two empty windows have drift 0.
    """
    cats = rows.groupBy(*keys, month).agg(F.collect_set(category).alias("c"))
    w = Window.partitionBy(*keys).orderBy(month)
    gather = lambda a, b: F.array_distinct(F.flatten(F.collect_list("c").over(w.rangeBetween(a, b))))
    seen = cats.select(*keys, month, gather(1 - months, 0).alias("now"), gather(1 - 2 * months, -months).alias("then"))
    everything = F.size(F.array_union("now", "then"))
    return seen.select(*keys, month, F.when(everything == 0, 0.0).otherwise(1 - F.size(F.array_intersect("now", "then")) / everything).alias("drift"))


def implied_value(metric: Column, peers: Column, multiple: Column, mark: Column, least: int = 3) -> tuple[Column, Column]:
    """(value, method): the peers' multiple if there are enough of them, else the last mark, else nothing."""
    enough = (peers >= least) & multiple.isNotNull()
    return F.when(enough, metric * multiple).otherwise(mark), F.when(enough, "peers").when(mark.isNotNull(), "mark").otherwise("none")
