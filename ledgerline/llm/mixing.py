"""Mixes sources to target weights by pivotal dependent rounding, in SQL functions only.

Each source's target is its weight's share of all words, at most three times its
own words. Its documents then have the fractional number of copies target / size
of source. The whole part is certain; the fraction is rounded dependently: two
documents meet, word mass moves from one to the other at random (so that each
keeps its expected copies and both keep their joint words) until one of them is
integral, and the other goes on. This runs as a reduction tree: buckets of
bounded size fold to one residual each, whose survivors are dealt into fewer
buckets, until one residual a source is left; that one is rounded. A source's
taken words so differ from its target by less than the size of one document.

Buckets come from a hash of the document's id and the level, and so do the
random numbers: reruns agree, and a source with a third of all rows is just more
buckets. Each level is a shuffle of one row per bucket of the level before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stage, table, text_or_empty

#: Documents that fold to one residual.
FAN_IN = 128
MOST_COPIES = 3
EPS = 1e-9


def count_words(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n, target from rows of source and size: one row a source.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating.
    A target above cap times the source's size stops there, and the excess is
    shared by weight among the others until none is above. That fixed point is a
    water level: sources by cap / weight, and the first level that leaves all the
    following ones below their caps.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, rest, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", F.when(level <= F.col("most") / F.col("weight"), level))
    first = F.first("level", ignorenulls=True).over(everything)
    return leveled.withColumn("water", first).select(
        "source", "source_size", "n", F.coalesce(F.least(F.col("most"), F.col("weight") * F.col("water")), F.col("most")).alias("target")
    )


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _meet(state: Column, x: Column) -> Column:
    """One meeting of the residual with the next unit: (residual, decided units)."""
    r = state["residual"]
    up = F.least(r["w"] * (1 - r["p"]), x["w"] * x["p"])  # words that may move to the residual
    down = F.least(r["w"] * r["p"], x["w"] * (1 - x["p"]))  # or from it
    move = F.when(_uniform(F.lit(11), r["id"], r["w"], x["id"], x["w"]) * (up + down) < down, up).otherwise(-down)

    def moved(unit: Column, p: Column) -> Column:
        p = F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        return F.struct(unit["id"].alias("id"), unit["w"].alias("w"), p.alias("p"))

    pair = F.array(moved(r, r["p"] + move / r["w"]), moved(x, x["p"] - move / x["w"]))
    # At least one of the two is integral now; the first fractional one goes on, if any.
    on = F.transform(F.array(pair), lambda two: F.when((two[0]["p"] > 0) & (two[0]["p"] < 1), F.struct(two[0].alias("residual"), two[1].alias("done"))).otherwise(F.struct(two[1].alias("residual"), two[0].alias("done"))))[0]
    return F.struct(on["residual"].alias("residual"), F.concat(state["done"], F.array(on["done"])).alias("done"))


def _fold(units: DataFrame) -> DataFrame:
    """sid, buckets, residual, done: each bucket's units, largest first, folded to one residual."""
    grouped = units.groupBy("sid", "buckets", "bucket").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("order"), "id", "w", "p"))).alias("units"))
    unit = lambda u: F.struct(u["id"].alias("id"), u["w"].alias("w"), u["p"].alias("p"))
    start = F.struct(unit(F.col("units")[0]).alias("residual"), F.filter(F.array(unit(F.col("units")[0])), lambda u: F.lit(False)).alias("done"))
    folded = F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))), start, lambda s, u: _meet(s, unit(u)))
    return grouped.select("sid", "buckets", folded.alias("f")).select("sid", "buckets", "f.residual", "f.done")


def pivotal_round(units: DataFrame, largest: int) -> DataFrame:
    """sid, id, extra (0 or 1) for units (sid, n, id, w > 0, 0 < p < 1); largest: the most units of a sid."""
    level, buckets = 0, F.ceil(F.col("n") / F.lit(FAN_IN))
    state = units.select("sid", "id", "w", "p", buckets.alias("buckets"))
    decided = None
    while True:
        state = state.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "id", "w"), F.greatest(F.col("buckets"), F.lit(1))))
        folded = stage(_fold(state), f"mix-level{level}")
        done = folded.select("sid", F.explode("done").alias("u")).select("sid", "u.id", (F.col("u.p") > 0.5).cast("int").alias("extra"))
        decided = done if decided is None else decided.unionByName(done)
        if largest <= FAN_IN:
            last = folded.select("sid", "residual.id", (F.col("residual.p") >= 0.5).cast("int").alias("extra"))
            return decided.unionByName(last)
        level, largest = level + 1, math.ceil(largest / FAN_IN)
        # A residual that came out integral meets nobody; with p 0 or 1 it moves no mass.
        state = folded.select("sid", "residual.*", F.ceil(F.col("buckets") / F.lit(FAN_IN)).alias("buckets"))


def mix_copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Rows that repeat an id, source and size are one unit and get equal copies.
    Null sources are a source of their own, null ids a document. Empty and null
    texts have size 0 and take no words; they keep the whole part of their
    copies. An empty table gives an empty result; other columns are ignored.
    """
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(text_col).alias("size")), "mix-sizes")
    sources = stage(source_targets(rows, weights, cap).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "mix-sources")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = F.round(F.least(share, F.lit(float(cap))), 12)
    with_source = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select(
        "doc_id", rows["source"], "size", "source_size", "target", "sid", "n", F.floor(share).alias("whole"), (share - F.floor(share)).alias("p")
    )
    units = with_source.filter((F.col("size") > 0) & (F.col("p") > EPS) & (F.col("p") < 1 - EPS)).groupBy("sid", "n", "doc_id", "size").agg(F.count("*").alias("rows"), F.first("p").alias("p"))
    units = units.select("sid", "n", F.struct("doc_id", "size").alias("id"), (F.col("size") * F.col("rows")).cast("double").alias("w"), "p")
    largest = sources.agg(F.max("n")).first()[0] or 0
    extra = pivotal_round(units, largest).select("sid", F.col("id.doc_id").alias("doc_id"), F.col("id.size").alias("size"), "extra")
    left, right = with_source.alias("l"), extra.alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.sid") == F.col("r.sid")), "left")
    copies = (F.col("whole") + F.coalesce(F.col("extra"), (F.col("p") > 0.5).cast("int"))).cast("long")
    return joined.select("l.doc_id", "source", "l.size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it; same columns."""
    found = mix_copies(docs, weights, cap, id_col, text_col, source_col).filter("copies > 0")
    names = [fresh(c, docs) for c in ("mix_id", "mix_source", "mix_size", "mix_copies")]
    found = found.groupBy("doc_id", "source", "size").agg(F.first("copies").alias("copies")).toDF(*names)
    size = fresh("size_", docs)
    rows = docs.withColumn(size, count_words(text_col))
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col(names[0])) & F.col(source_col).eqNullSafe(F.col(names[1])) & (F.col(size) == F.col(names[2])))
    return joined.withColumn(size, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*docs.columns)


def op1_mixing(spark, sf_dir):
    return mix_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
