"""Entity resolution: cascades of keys, fuzzy matching in blocks, merging and reconciling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import fund_key
from .graph import staged
from .joins import latest_by


#: Keys of a person in order of trust, and the score of a match by each.
KEYS = [("email", 1.0), ("linkedin", 0.95), ("phone", 0.9), ("name_firm", 0.75), ("name_city", 0.65)]


def cascade(new: DataFrame, known: DataFrame, keys: list[tuple[str, float]], new_id: str, known_id: str, created: str) -> DataFrame:
    """For each new row the best known row: new_id, known_id, key, score.

    Each key column is an equi-join of its own (null keys never meet); the best
    score wins, then the newest known row, then the smaller id. Of the known rows of a
    value only the best can win, so a new row meets one at most by each key.
    """
    parts = []
    for key, score in keys:
        left = new.filter(F.col(key).isNotNull()).select(new_id, F.col(key).alias("_key"))
        right = known.filter(F.col(key).isNotNull()).select(known_id, created, F.col(key).alias("_key"))
        parts.append(left.join(latest_by(right, ["_key"], F.desc(created), F.asc(known_id)), "_key").select(new_id, known_id, created, F.lit(key).alias("key"), F.lit(score).alias("score")))
    found = reduce(DataFrame.unionByName, parts)
    return latest_by(found, [new_id], F.desc("score"), F.desc(created), F.asc(known_id)).drop(created)


def decide(score: Column, merge: float = 0.85, review: float = 0.6) -> Column:
    return F.when(score >= merge, "merge").when(score >= review, "review").otherwise("new")


#: Confidence of a fund's match by each way; below CREATE it is a new fund, of confidence NEW.
FUND_SCORES = {"exact_name+vintage": 0.95, "exact_name": 0.85, "prefix": 0.7, "gp+suffix": 0.65}
NEW = 0.5


def resolve_funds(asked: DataFrame, known: DataFrame) -> DataFrame:
    """q, best, score, matched_by of every asked (q, name, vintage, firm) among known (id, name, vintage, firm).

    By plain names without legal forms: equal ones (better if vintages are a year apart at most), else one that begins
    with the other, else funds of the firm that is asked for; ties by the smaller id. What matches nothing is
    'created', without a best. Names meet by equi-joins: as they are, and as their beginnings.
    Known funds are first made one for each name and vintage, and one for each firm.
    """
    k = known.select("id", fund_key(F.col("name")).alias("n"), "vintage", "firm")
    q = asked.select("q", fund_key(F.col("name")).alias("n"), F.col("vintage").alias("v"), "firm")
    names = k.filter("n <> ''").groupBy("n", "vintage").agg(F.min("id").alias("id"))
    one = names.groupBy("n").agg(F.min("id").alias("id"))
    here = q.filter("n <> ''")
    starts = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, F.lit(1), i))
    longer = lambda df, *keep: df.filter(F.length("n") > 1).select(*keep, F.explode(starts(F.col("n"))).alias("n"))
    tag = lambda df, how: df.select("q", "id", F.lit(how).alias("matched_by"))
    close = F.coalesce(F.abs(F.col("vintage") - F.col("v")) <= 1, F.lit(False))
    exact = here.join(names, "n")
    found = [
        tag(exact.filter(close), "exact_name+vintage"),
        tag(exact.filter(~close), "exact_name"),
        tag(longer(here, "q").join(one, "n"), "prefix"),
        tag(here.join(longer(one, "id"), "n"), "prefix"),
        tag(q.join(k.groupBy("firm").agg(F.min("id").alias("id")), "firm"), "gp+suffix"),
    ]
    score = F.coalesce(*(F.when(F.col("matched_by") == how, s) for how, s in FUND_SCORES.items()))
    best = latest_by(reduce(DataFrame.unionByName, found).withColumn("score", score), ["q"], F.desc("score"), F.asc("id"))
    joined = asked.select("q").join(best, "q", "left")
    return joined.select("q", F.col("id").alias("best"), F.coalesce("score", F.lit(NEW)).alias("score"), F.coalesce("matched_by", F.lit("created")).alias("matched_by"))


def watchlist(asked: DataFrame, listed: DataFrame, least: float = 0.85, share: int = 2_000_000) -> DataFrame:
    """q, id, score, method of every asked (q, name, dob, country) and listed (id, name, dob, country) whose names match well enough.

    Equal plain names score 1; else half the share of like-sounding words and half the mean of each word's best spelling, both ways,
    times 0.65 if two known dates of birth differ and 0.85 if two known countries do. Sides may have `aliases` (arrays): the best of all
    pairs of names counts. A score above 0.5 needs a like-sounding word, so names meet by the sounds of their words, and only names:
    each distinct name once. Then profiles meet (all names, date and country), each distinct one once, and the people who have
    them are joined last, so no task gathers people, about `share` rows in a task. q and id are unique.
    """
    if least <= 0.5:
        raise ValueError("names meet by a like-sounding word, which scores up to 0.5 do not need")

    def profiles(side: DataFrame, own: str, p: str, n: str, d: str, c: str) -> DataFrame:
        every = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in side.columns else F.array("name")
        plain = F.array_sort(F.array_distinct(F.transform(F.array_compact(every), tx.person_name)))
        rows = side.select(own, plain.alias(n), F.substring("dob", 1, 10).alias(d), F.substring(F.lower("country"), 1, 2).alias(c))
        return rows.withColumn(p, F.to_json(F.struct(n, d, c)))

    def words(side: DataFrame, w: str) -> DataFrame:
        distinct = side.select("_n").distinct().select("_n", tx.name_words(F.col("_n")).alias(w))
        return distinct.select("*", F.transform(w, tx.metaphone).alias(f"{w}_sounds"))

    people, list_ = profiles(asked, "q", "pa", "na", "d1", "c1"), profiles(listed, "id", "pb", "nb", "d2", "c2")
    left = people.dropDuplicates(["pa"]).select("pa", "d1", "c1", F.explode("na").alias("na"))
    right = list_.dropDuplicates(["pb"]).select("pb", "d2", "c2", F.explode("nb").alias("nb"))
    a, b = words(left.withColumnRenamed("na", "_n"), "a"), words(right.withColumnRenamed("nb", "_n"), "b")
    met = a.select(F.col("_n").alias("na"), "a", F.filter("a_sounds", lambda x: x != "").alias("sa"), F.explode(F.array_distinct("a_sounds")).alias("sound")).join(
        b.select(F.col("_n").alias("nb"), "b", F.filter("b_sounds", lambda x: x != "").alias("sb"), F.explode(F.array_distinct("b_sounds")).alias("sound")), "sound"
    ).filter("sound <> ''").dropDuplicates(["na", "nb"])
    phonetic = F.size(F.filter("sa", lambda x: F.array_contains("sb", x))) / F.greatest(F.size("sa"), F.size("sb"))
    alike = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    nearest = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: alike(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    fuzzy = (nearest("a", "b") + nearest("b", "a")) / 2
    scored = met.select("na", "nb", phonetic.alias("p"), fuzzy.alias("f")).select("na", "nb", (0.5 * F.col("p") + 0.5 * F.col("f")).alias("s"), F.when(F.col("p") >= F.col("f"), "phonetic").otherwise("fuzzy").alias("method"))
    equal = a.select(F.col("_n").alias("na")).join(b.select(F.col("_n").alias("nb")), F.col("na") == F.col("nb")).filter("na <> ''").select("na", "nb", F.lit(1.0).alias("s"), F.lit("exact").alias("method"))
    pairs = scored.filter(F.col("s") >= least).filter("na <> nb").unionByName(equal)
    joined = pairs.join(left, "na").join(right, "nb")
    known = (F.length("d1") >= 4) & (F.length("d2") >= 4) & (F.col("d1") != F.col("d2"))
    gate = F.when(F.coalesce(known, F.lit(False)), 0.65).otherwise(1.0) * F.when(F.coalesce(F.col("c1") != F.col("c2"), F.lit(False)), 0.85).otherwise(1.0)
    gated = joined.withColumn("score", F.when(F.col("method") == "exact", F.col("s")).otherwise(F.col("s") * gate)).filter(F.col("score") >= least)
    best = gated.groupBy("pa", "pb").agg(F.max(F.struct("score", "method")).alias("m")).select("pa", "pb", "m.*")
    # Few profiles may stand for most people: those who ask are dealt, so that many tasks make the rows of a pair of profiles.
    best, own = staged(best, "profiles"), staged(people.select("q", "pa"), "profiles")
    kinds = staged(best.select("pb").distinct().withColumn("_k", F.monotonically_increasing_id()), "profiles")
    theirs = staged(list_.select("id", "pb").join(kinds, "pb").select("id", "_k"), "profiles")
    best = best.join(kinds, "pb").select("pa", "_k", "score", "method")
    bearers = lambda df, p: df.groupBy(p).agg(F.count("*").alias(f"n{p}"))
    sized = best.join(bearers(own, "pa"), "pa").join(bearers(theirs, "_k"), "_k")
    total, n = sized.agg(F.sum(F.col("npa") * F.col("n_k")), F.count_distinct("_k")).first()
    parts = max(int(best.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // share))
    deal = min(parts, -(-4 * parts // max(n, 1)))
    left = own.withColumn("_d", F.pmod(F.xxhash64("q"), F.lit(deal)).cast("int")).join(best, "pa").select("q", "_k", "_d", "score", "method").repartition(parts, "_k", "_d")
    right = theirs.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    return left.join(right.hint("merge"), ["_k", "_d"]).select("q", "id", "score", "method")


def fuzzy_names(rows: DataFrame, id_col: str, block: Column, name: str, least: float) -> DataFrame:
    """a, b, score: within a block, rows of one name with its first row (score 1), and first rows of like names with each other.

    Names are compared once however many rows bear them, and only where their lengths allow the score.
    """
    named = rows.select(block.alias("block"), F.col(id_col).alias("id"), F.col(name).alias("name"))
    classes = named.groupBy("block", "name").agg(F.min("id").alias("rep"))
    same = named.join(classes, ["block", "name"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    x, y = classes.toDF("block", "na", "a"), classes.toDF("block", "nb", "b")
    la, lb = F.length("na"), F.length("nb")
    met = x.join(y, "block").filter(F.col("a") < F.col("b")).filter(F.abs(la - lb) <= (1 - least) * F.greatest(la, lb) + 1e-9)
    like = met.select("a", "b", tx.name_similarity(F.col("na"), F.col("nb")).alias("score")).filter(F.col("score") >= least)
    return same.unionByName(like)


def merge_fields(rows: DataFrame, key: str, fields: list[str], priority: Column, tie: str) -> DataFrame:
    """One row per key; each field is its non-null value of highest priority, later ties winning."""
    order = F.struct(priority.alias("p"), F.col(tie))
    return rows.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields), F.count("*").alias("n_sources"))


def reconcile(rows: DataFrame, key: list[str], amount: str, day: str, authority: str, source: str, confidence: float) -> DataFrame:
    """One row per key from several sources.

    The most authoritative row gives amount and day; it is disputed if another
    differs by more than 5 per cent or 14 days, else corroborated if two sources
    or more report it; each further source adds 0.1 of confidence, 0.99 at most.
    """
    order = F.struct(authority, (-F.unix_date(F.col(day).cast("date"))).alias("early"), source, amount)
    best = rows.groupBy(*key).agg(F.max_by(F.struct(amount, day), order).alias("b"), F.countDistinct(source).alias("sources"), F.min(amount).alias("lo"), F.max(amount).alias("hi"), F.min(F.col(day).cast("date")).alias("d0"), F.max(F.col(day).cast("date")).alias("d1"))
    value, at = F.col(f"b.{amount}"), F.col(f"b.{day}").cast("date")
    off = F.greatest(F.col("hi") - value, value - F.col("lo")) > 0.05 * F.abs(value)
    late = F.greatest(F.datediff("d1", at), F.datediff(at, "d0")) > 14
    status = F.when(off | late, "disputed").when(F.col("sources") >= 2, "corroborated").otherwise("single")
    return best.select(*key, value.alias(amount), at.cast("string").alias(day), "sources", status.alias("status"), F.round(F.least(F.lit(0.99), confidence + 0.1 * (F.col("sources") - 1)), 4).alias("confidence"))


def supersede(facts: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Facts with equal keys and value become one with its last observation; the newest of a key is current."""
    digest = F.sha2(F.concat_ws("|", *keys, value), 256)
    merged = facts.groupBy(*keys, value).agg(F.min(at).alias("first_seen"), F.max(at).alias("observed_at"), F.count("*").alias("n"))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("observed_at"), value))
    return merged.withColumn("hash", digest).withColumn("is_current", (newest == 1).cast("int"))


def repoint(edges: DataFrame, canonical: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between canonical ids: distinct, without loops. canonical: id, canonical_id."""
    one = canonical.select(F.col("id").alias(src), F.col("canonical_id").alias("_s"))
    two = canonical.select(F.col("id").alias(dst), F.col("canonical_id").alias("_d"))
    moved = edges.join(one, src, "left").join(two, dst, "left").select(F.coalesce("_s", src).alias(src), F.coalesce("_d", dst).alias(dst))
    return moved.filter(F.col(src) != F.col(dst)).distinct()
