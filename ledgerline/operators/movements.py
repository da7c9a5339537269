"""Movements of people between snapshots of teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of titles by the words they hold, the first that fits.
RANKS = (
    (10, ("managing partner", "senior managing director")),
    (9, ("general partner", "gp", "founding partner", "managing director")),
    (8, ("partner",)),
    (7, ("vice president", "vp", "principal")),
    (6, ("senior associate",)),
    (5, ("associate",)),
    (4, ("operating partner", "venture partner")),
    (3, ("analyst", "investor")),
)


def title_rank(title: Column) -> Column:
    """Null for a title that none of the ranks knows."""
    return F.coalesce(*(F.when(title.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), rank) for rank, words in RANKS))


def movements(members: DataFrame, snapshots: DataFrame, firm: str, at: str, member: str, title: str) -> DataFrame:
    """firm, member, movement (joined, left, promoted or title_change), at, from_title, to_title of all consecutive snapshots.

    members: firm, at, member, title, a row each; snapshots: firm, at of every snapshot, those without members too. A snapshot without
    members is a failed one: neither it nor the one after it is compared. Somebody left who is in a snapshot and in neither of the
    next two, at the first of them; who is back in the second never left, and joins again. A promotion is a change to a title of higher
    rank, if both have one; titles that differ in spaces around them don't.
    """
    sized = snapshots.select(firm, at).distinct().join(members.groupBy(firm, at).agg(F.count("*").alias("_n")), [firm, at], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    in_firm = Window.partitionBy(firm).orderBy(at)
    ahead = [F.lead(c, k).over(in_firm).alias(f"_{c.strip('_')}{k}") for k in (1, 2) for c in (at, "_n")]
    line = sized.select(firm, at, F.row_number().over(in_firm).alias("_seq"), F.lag("_n").over(in_firm).alias("_before"), "_n", *ahead)
    plain = F.nullif(F.trim(F.col(title)), F.lit(""))
    of_member = Window.partitionBy(firm, member).orderBy("_seq")
    seen = members.select(firm, at, member, plain.alias("_title")).join(line, [firm, at])
    seen = seen.withColumns({"_last": F.lag("_seq").over(of_member), "_was": F.lag("_title").over(of_member), "_next": F.lead("_seq").over(of_member)})
    none = F.lit(None).cast("string")
    compared = (F.col("_before") > 0) & (F.col("_n") > 0)
    stayed = F.col("_last").eqNullSafe(F.col("_seq") - 1)
    joined = seen.filter(compared & ~stayed).select(firm, member, F.lit("joined").alias("movement"), at, none.alias("from_title"), F.col("_title").alias("to_title"))
    away = F.coalesce(F.col("_next") > F.col("_seq") + 2, F.lit(True))
    left = seen.filter(away & (F.col("_n1") > 0) & (F.col("_n2") > 0)).select(firm, member, F.lit("left").alias("movement"), F.col(f"_{at}1").alias(at), F.col("_title").alias("from_title"), none.alias("to_title"))
    rises = F.coalesce(title_rank(F.col("_title")) > title_rank(F.col("_was")), F.lit(False))
    other = seen.filter(compared & stayed & ~F.col("_was").eqNullSafe(F.col("_title"))).select(firm, member, F.when(rises, "promoted").otherwise("title_change").alias("movement"), at, F.col("_was").alias("from_title"), F.col("_title").alias("to_title"))
    return joined.unionByName(left).unionByName(other)


# Titles of partners.
PARTNERS = ("partner", "gp", "general partner", "managing director", "managing partner")


def carry_breadth(members: DataFrame, snapshots: DataFrame, filings: DataFrame, firm: str, at: str, title: str, filed: str, eligible: str) -> DataFrame:
    """firm, breadth, partner_count, eligible: how widely a firm shares its profits, by its last snapshot and its last filing.

    broad: as many are eligible as there are partners, or more; concentrated: fewer than half of them, rounded up; else, without partners, or with either number
    unknown: unknown. The last snapshot counts even if it is empty, and of the last filing the number even if it is null; several filings of one day: the least number.
    """
    last = snapshots.groupBy(firm).agg(F.max(at).alias(at))
    partner = F.coalesce(F.col(title).rlike(r"(?i)\b(" + "|".join(PARTNERS) + r")\b"), F.lit(False))
    counted = members.join(last, [firm, at]).groupBy(firm).agg(F.sum(partner.cast("long")).alias("partner_count"))
    partners = last.select(firm).join(counted, firm, "left").withColumn("partner_count", F.coalesce("partner_count", F.lit(0)))
    filed_last = filings.groupBy(firm).agg(F.max_by(F.struct(eligible), F.struct(F.col(filed), -F.col(eligible)))[eligible].alias("eligible"))
    both = partners.join(filed_last, firm, "full")
    n, e = F.col("partner_count"), F.col("eligible")
    known = (n > 0) & e.isNotNull()
    breadth = F.when(known & (e >= n), "broad").when(known & (e < F.ceil(n / 2)), "concentrated").otherwise("unknown")
    return both.select(firm, breadth.alias("breadth"), "partner_count", "eligible")
