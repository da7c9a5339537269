"""Weighted scores with their parts and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted(parts: dict[str, tuple[Column, float]], places: int = 3) -> Column:
    """The weighted sum of parts over the sum of weights."""
    total = sum(w for _, w in parts.values())
    return F.round(reduce(lambda a, b: a + b, (c * w for c, w in parts.values())) / total, places)


def weighted_present(parts: dict[str, tuple[Column, float]], places: int = 4) -> Column:
    """As weighted, over the parts that are not null; null if all are."""
    top = reduce(lambda a, b: a + b, (F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()))
    bottom = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()))
    return F.round(F.try_divide(top, bottom), places)


def reasons(parts: dict[str, tuple[Column, float]], k: int = 3) -> Column:
    """Names of the k parts that contribute most, comma-joined; ties by name; zero parts are left out."""
    entries = F.array(*(F.struct((-c * w).alias("v"), F.lit(n).alias("n")) for n, (c, w) in parts.items()))
    best = F.slice(F.array_sort(F.filter(entries, lambda e: e["v"] < 0)), 1, k)
    return F.array_join(F.transform(best, lambda e: e["n"]), ",")


def closeness(steps: Column, per_step: float = 0.25) -> Column:
    """1 at distance 0, less by per_step for each step, not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(steps) * per_step)


def verified(citations: DataFrame, fact: str, as_of: Column) -> DataFrame:
    """fact, verified: eight signals of a fact's citations, clamped to 0..1.

    citations: fact, host, reputability, government, archived, published, sentiment, contradicts. Hosts of a reputability of 0.7
    count 0.3 each; a primary source (0.9), a government and an archived copy once; the most recent by steps of 30, 180 and 365
    days; favourable ones add 0.05 each and contradicting ones take 0.1.
    """
    any_of = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    age = F.datediff(as_of, F.col("published").cast("date"))
    recent = F.when(age < 30, 1.0).when(age < 180, 0.5).when(age < 365, 0.2).otherwise(0.0)
    raw = (
        0.30 * F.count_distinct(F.when(F.col("reputability") >= 0.7, F.col("host"))) + 0.20 * any_of(F.col("reputability") >= 0.9) + 0.20 * any_of(F.col("government")) + 0.15 * any_of(F.col("archived"))
        + 0.10 * F.max(recent) + 0.05 * F.count_if(F.col("sentiment") > 0.2) - 0.10 * F.count_if(F.col("contradicts"))
    )
    return citations.groupBy(fact).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("verified"))


def fuse_hits(hits: DataFrame, keys: list[str], caps: dict[str, float], strong: list[str], default_cap: float = 0.9, auto: float = 0.95) -> DataFrame:
    """keys, method (of the best hit), confidence, methods, auto_link of hits (keys, method, confidence).

    A hit counts up to its method's cap; each further method adds 0.07, 0.99 at most. Strong methods link on their own from the
    threshold on, others with a second method.
    """
    cap = F.coalesce(*(F.when(F.col("method") == m, v) for m, v in caps.items()), F.lit(default_cap))
    each = hits.groupBy(*keys, "method").agg(F.max(F.least(F.col("confidence"), cap)).alias("c"))
    best = F.max(F.struct("c", "method"))
    g = each.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("methods"))
    fused = F.when(F.col("methods") >= 2, F.least(F.lit(0.99), F.col("b.c") + 0.07 * (F.col("methods") - 1))).otherwise(F.col("b.c"))
    scored = g.select(*keys, F.col("b.method").alias("method"), fused.alias("confidence"), "methods")
    return scored.withColumn("auto_link", (F.col("confidence") >= auto) & (F.col("method").isin(*strong) | (F.col("methods") >= 2)))


def graded(shape: Column) -> tuple[Column, Column]:
    """(predicted, actual) of a prediction by its shape, for calibration; columns value, threshold, label, probability, tolerance, outcome, outcome_label.

    scalar_threshold: right if both are on one side, with the margin as confidence; categorical_match: labels agree; numeric_proximity: within the
    tolerance; any other is boolean, with an outcome above 0.5.
    """
    value, outcome, threshold = F.col("value"), F.coalesce("outcome", F.lit(0.0)), F.coalesce("threshold", F.lit(0.0))
    inside = (F.abs(value - outcome) <= F.coalesce("tolerance", F.lit(0.0))).cast("double")
    side = ((value >= threshold) == (outcome >= threshold)).cast("double")
    sure = F.least(F.lit(1.0), 0.5 + F.abs(value - threshold) / F.greatest(F.abs(threshold), F.lit(1.0)))
    alike = (F.lower(F.coalesce("label", F.lit(""))) == F.lower(F.coalesce("outcome_label", F.lit("")))).cast("double")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    predicted = F.when(shape == "scalar_threshold", F.when(side == 1, sure).otherwise(1 - sure)).when(shape == "categorical_match", unit(F.coalesce("probability", "value", alike)))
    predicted = predicted.when(shape == "numeric_proximity", unit(F.coalesce("probability", F.when(inside == 1, 0.85).otherwise(0.15)))).otherwise(unit(value))
    actual = F.when(shape == "scalar_threshold", side).when(shape == "categorical_match", alike).when(shape == "numeric_proximity", inside).otherwise((outcome > 0.5).cast("double"))
    return predicted, actual


# How much each reason for following a link weighs.
REASONS = {
    "linked_team_member": 1.0, "linked_portfolio_company": 1.0, "linked_social_handle": 0.9, "linked_publication": 0.6, "same_domain_about_page": 0.6,
    "mentioned_email_domain": 0.5, "linked_external_press": 0.3,
}


def frontier(reason: Column, authority: Column, age_days: Column) -> Column:
    """Priority of a link: its reason's weight times the source's authority (0.05 to 1) times its novelty, 1 if never seen and half after a week."""
    weight = F.coalesce(*(F.when(reason == r, w) for r, w in REASONS.items()))
    novelty = F.coalesce(F.greatest(F.lit(0.05), 1 / (1 + F.greatest(age_days, F.lit(0)) / 7)), F.lit(1.0))
    return F.round(weight * F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(authority, F.lit(0.5)))) * novelty, 4)
