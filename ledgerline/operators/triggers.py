"""Monitoring rules: what changed between two summaries of an entity, and what its feeds brought since it was last looked at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headlines that count as adverse, and as funding news.
ADVERSE = r"(?i)lawsuit|fraud|scandal|charged|indict|sec\s*probe|investigation|fired|resign|breach|hack|leak|fine|penalt"
FUNDING = r"(?i)raise[ds]?|round|series\s*[a-f]|seed|funding|capital"
SEVERITIES = ("low", "medium", "high", "critical")
#: Fields of a summary that any_change compares.
FIELDS = ("title", "role", "employer", "employer_id", "city", "country", "fit_max_score", "intent_score", "dd_risk_score", "dd_findings", "handles_count")


def _differs(field: str) -> Column:
    return ~F.col(f"old.{field}").eqNullSafe(F.col(f"new.{field}"))


def _moved(field: str, least: float) -> Column:
    return _differs(field) & (F.abs(F.coalesce(f"new.{field}", F.lit(0)) - F.coalesce(f"old.{field}", F.lit(0))) >= least)


def summary_triggers(summaries: DataFrame, min_delta: float = 5, min_severity: str = "low") -> DataFrame:
    """entity, kind, dedupe_key: the ten rules on summaries (entity, old, new), structs of FIELDS.

    dd_findings is a struct of counts by severity. An entity without an old summary is a baseline and fires
    nothing; null equals null. One pass without a shuffle.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    changed = F.array_compact(F.array(*(F.when(_differs(f), F.lit(f)) for f in sorted(FIELDS))))
    severe = SEVERITIES[SEVERITIES.index(min_severity) :]
    grown = F.array_compact(F.array(*(F.when(F.coalesce(f"new.dd_findings.{s}", F.lit(0)) > F.coalesce(f"old.dd_findings.{s}", F.lit(0)), F.lit(s)) for s in severe)))
    score = lambda f: F.round(F.col(f"new.{f}")).cast("long").cast("string")
    rules = {
        "any_change": (F.size(changed) > 0, F.array_join(changed, ",")),
        "title_change": (_differs("title"), text("new.title")),
        "new_employer": ((_differs("employer") | _differs("employer_id")) & F.col("new.employer").isNotNull() & _differs("employer"), F.coalesce(F.col("new.employer_id").cast("string"), "new.employer")),
        "geo_change": (_differs("city") | _differs("country"), F.concat(text("new.city"), F.lit("|"), text("new.country"))),
        "fit_score_change": (_moved("fit_max_score", min_delta), score("fit_max_score")),
        "intent_score_change": (_moved("intent_score", min_delta), score("intent_score")),
        "dd_score_change": (_moved("dd_risk_score", min_delta), score("dd_risk_score")),
        "dd_finding_new": (F.size(grown) > 0, F.array_join(grown, ",")),
        "handle_added": (F.coalesce("new.handles_count", F.lit(0)) > F.coalesce("old.handles_count", F.lit(0)), F.concat(text("old.handles_count"), F.lit("->"), text("new.handles_count"))),
        "executive_change": (_differs("role") | _differs("title"), F.concat(text("new.title"), F.lit("|"), text("new.role"))),
    }
    fired = F.array_compact(F.array(*(F.when(F.col("old").isNotNull() & c, F.struct(F.lit(kind).alias("kind"), key.alias("dedupe_key"))) for kind, (c, key) in rules.items())))
    return summaries.select("entity", F.explode(fired).alias("f")).select("entity", "f.*")


def news_feeds(news: DataFrame) -> dict[str, DataFrame]:
    """new_news_item, adverse_media and the news of funding_event, from news (entity, id, at, title, sentiment)."""
    adverse = F.coalesce(F.col("sentiment").rlike("(?i)negative|adverse|risk"), F.lit(False)) | F.coalesce(F.col("title").rlike(ADVERSE), F.lit(False))
    return {"new_news_item": news, "adverse_media": news.filter(adverse), "funding_event": news.filter(F.col("title").rlike(FUNDING))}


def feed_triggers(feeds: dict[str, DataFrame], watermarks: DataFrame, parts: int = 0, salts: int = 8) -> DataFrame:
    """entity, kind, dedupe_key, n: for each kind's feed (entity, id, at) the newest row after the entity's watermark, and how many there are.

    watermarks: entity, since; an entity without one has seen nothing. A kind may stand in several feeds: `kind` or `kind:rank`, and
    an entity takes it from the least rank that has rows. Ties of time go to the greatest id.

    Rows are dealt into `parts` tasks (the session's number at least) by entity and by one of `salts` shares of its ids, so that an
    entity with very many rows is not one task's; the newest of its shares then meet.
    """
    tagged = []
    for name, rows in feeds.items():
        kind, _, rank = name.partition(":")
        tagged.append(rows.select("entity", F.lit(kind).alias("kind"), F.lit(int(rank or 0)).alias("rank"), F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp_ntz").alias("at")))
    parts = max(parts, int(watermarks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = reduce(DataFrame.unionByName, tagged).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).repartition(parts, "entity", "salt")
    since = watermarks.select("entity", "since", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt")).repartition(parts, "entity", "salt")
    unseen = rows.join(since, ["entity", "salt"], "left").filter(F.col("since").isNull() | (F.col("at") > F.col("since")))
    some = unseen.groupBy("entity", "salt", "kind", "rank").agg(F.max(F.struct("at", "id")).alias("last"), F.count("*").alias("n")).drop("salt")
    newest = some.repartition(parts, "entity", "kind").groupBy("entity", "kind", "rank").agg(F.max("last")["id"].alias("dedupe_key"), F.sum("n").alias("n"))
    first = newest.groupBy("entity", "kind").agg(F.min_by(F.struct("dedupe_key", "n"), "rank").alias("f"))
    return first.select("entity", "kind", "f.*")


def matching(rows: DataFrame, one_of: dict[str, list] | None = None, at_least: dict[str, float] | None = None, any_tag: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of a shared feed that a rule's settings select; a rule without settings selects nothing."""
    conditions = [F.col(c).isin(*values) for c, values in (one_of or {}).items() if values]
    conditions += [F.col(c) >= v for c, v in (at_least or {}).items()]
    conditions += [F.arrays_overlap(F.col(c), F.array(*map(F.lit, tags))) for c, tags in (any_tag or {}).items() if tags]
    return rows.filter(reduce(lambda a, b: a & b, conditions)) if conditions else rows.filter(F.lit(False))
