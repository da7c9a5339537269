"""Ranked search of many phrases on an inverted index of short pieces."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

#: Characters of a piece at most, words of a phrase that count.
LONGEST, MOST = 3, 6


@dataclass
class TextIndex:
    """rows: id, title, subtitle, link, quality; postings: piece, id; counts: piece, n."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame


def _pieces(c: Column, n: Column | int) -> Column:
    """All runs of n characters of c."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def build_index(rows: DataFrame, id_col: str, title: str, subtitle: str, link: Column | None = None, quality: Column | None = None) -> TextIndex:
    """Each row's pieces of one to LONGEST characters of title and subtitle, letters' case aside. link: whether the row leads somewhere; quality: 0 to 100."""
    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    kept = rows.select(F.col(id_col).alias("id"), lowered(title).alias("title"), lowered(subtitle).alias("subtitle"), F.coalesce(link if link is not None else F.lit(False), F.lit(False)).alias("link"), F.coalesce(quality if quality is not None else F.lit(0.0), F.lit(0.0)).cast("double").alias("quality"))
    kept = staged(kept, "search-rows")
    every = F.concat(*(_pieces(F.col(c), n) for c in ("title", "subtitle") for n in range(1, LONGEST + 1)))
    postings = staged(kept.select(F.explode(F.array_distinct(every)).alias("piece"), "id"), "search-postings")
    return TextIndex(kept, postings, staged(postings.groupBy("piece").agg(F.count("*").alias("n")), "search-counts"))


def tokens(phrase: Column) -> Column:
    """The first MOST words, lower case, without the signs % and _."""
    words = F.transform(F.split(F.lower(phrase), r"\s+"), lambda w: F.trim(F.regexp_replace(w, "[%_]", "")))
    return F.slice(F.filter(words, lambda w: w != ""), 1, MOST)


def rank(phrase: Column, words: Column, title: Column, subtitle: Column, link: Column, quality: Column) -> Column:
    """Title equal to the phrase 500, beginning with it 400, holding it 250; 120 if each word begins one of the title's; a word in the title 40, else in the
    subtitle 15; a title of up to 24 characters 50; a link 25; quality up to 25."""
    base = F.when(title == phrase, 500).when(title.startswith(phrase), 400).when(title.contains(phrase), 250).otherwise(0)
    parts = F.filter(F.split(title, r"[\s\-_/.,()&]+"), lambda p: p != "")
    starts = (F.size(words) > 0) & F.forall(words, lambda w: F.exists(parts, lambda p: p.startswith(w)))
    each = F.aggregate(words, F.lit(0), lambda s, w: s + F.when(title.contains(w), 40).when(subtitle.contains(w), 15).otherwise(0))
    more = [F.when(starts, 120).otherwise(0), each, F.when(F.length(title).between(1, 24), 50).otherwise(0), F.when(link, 25).otherwise(0)]
    best = F.least(F.lit(25), F.greatest(F.lit(0), F.floor(quality / 4 + 0.5))).cast("int")
    return reduce(lambda a, b: a + b, more, base) + best


def search(index: TextIndex, queries: DataFrame, query_id: str, phrase: str, k: int) -> DataFrame:
    """query_id, id, score, place: for each phrase the k rows of best rank whose title or subtitle holds each of its words; ties by id.

    A phrase meets only the rows that hold its rarest piece, and only those are checked and ranked; equal phrases are searched once. A phrase without words finds nothing.
    """
    every = queries.select(F.col(query_id).alias("query"), F.trim(F.lower(phrase)).alias("phrase"), tokens(F.col(phrase)).alias("words")).filter(F.size("words") > 0)
    asked = staged(every.select("phrase", "words").distinct(), "search-phrases")
    pieces = F.flatten(F.transform("words", lambda w: _pieces(w, F.least(F.length(w), F.lit(LONGEST)))))
    each = asked.select("phrase", "words", F.explode(F.array_distinct(pieces)).alias("piece")).join(index.counts, "piece", "left")
    anchors = each.groupBy("phrase", "words").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    met = anchors.join(index.postings, "piece").join(index.rows, "id")
    held = met.filter(F.forall("words", lambda w: F.contains("title", w) | F.contains("subtitle", w)))
    scored = held.select("phrase", "words", "id", rank(*(F.col(c) for c in ("phrase", "words", "title", "subtitle", "link", "quality"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("phrase", "words").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("place", place).filter(F.col("place") <= k)
    return every.join(best, ["phrase", "words"]).select(F.col("query").alias(query_id), "id", "score", "place")
