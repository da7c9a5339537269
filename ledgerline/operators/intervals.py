"""Overlap joins of intervals by dyadic bins of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are below 2^LEVELS units.
LEVELS = 40


def _level(first: Column, last: Column) -> Column:
    """The least level whose bins are as long as the interval, so that it reaches into two of them at most."""
    return F.ceil(F.log2((last - first + 1).cast("double"))).cast("int")


def _shift(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], strict: bool = False) -> DataFrame:
    """All columns of pairs of left and right rows with equal keys whose closed intervals of whole numbers share a point.

    An interval stands in the one or two bins of its own level (home), and visits those of every longer level that the other side has. A pair
    meets where the longer one is at home, and is kept at its first common bin only. So an interval has a few dozen rows whatever its length, a frequent
    key is spread over its bins, and a task sees only intervals that are close in time. Intervals with a null end, or that end before
    they begin, meet nothing. Names of columns other than keys must differ. strict: sharing an end alone isn't an overlap.
    """

    def bins(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        first, last = (F.col(c).cast("long") for c in span)
        return df.withColumns({f"_f{side}": first, f"_t{side}": last}).filter(f"_f{side} <= _t{side}").withColumn(f"_l{side}", _level(F.col(f"_f{side}"), F.col(f"_t{side}")))

    def stand(df: DataFrame, side: str, at: Column) -> DataFrame:
        """A row for each bin at a level."""
        first, last = _shift(F.col(f"_f{side}"), at), _shift(F.col(f"_t{side}"), at)
        return df.withColumn("_bin", F.explode(F.sequence(first, last)))

    a, b = bins(left, left_span, "a"), bins(right, right_span, "b")
    common = F.col("_bin") == F.greatest(_shift(F.col("_fa"), F.col("_level")), _shift(F.col("_fb"), F.col("_level")))
    share = (F.col("_fa") < F.col("_tb")) & (F.col("_fb") < F.col("_ta")) if strict else (F.col("_fa") <= F.col("_tb")) & (F.col("_fb") <= F.col("_ta"))

    def met(home: DataFrame, h: str, visitor: DataFrame, v: str, least: int) -> DataFrame:
        """Pairs whose visitor is shorter than the one at home by least levels or more."""
        levels = home.select(F.col(f"_l{h}").alias("_level")).distinct()  # LEVELS rows at most
        at_home = stand(home.withColumn("_level", F.col(f"_l{h}")), h, F.col("_level"))
        visits = stand(visitor.join(F.broadcast(levels), F.col("_level") >= F.col(f"_l{v}") + least), v, F.col("_level"))
        return at_home.join(visits, [*keys, "_level", "_bin"]).filter(common & share)

    wanted = [*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys)]
    return met(a, "a", b, "b", 0).select(*wanted).unionByName(met(b, "b", a, "a", 1).select(*wanted))
