"""Model-quality metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

EPS = 1e-9


def per_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """class, tp, fp, fn, precision_, recall_, f1 for every class that is predicted or gold; 0 where undefined.

    Each row counts for its gold and its predicted class: no join with the classes.
    """
    hit = F.col(gold).eqNullSafe(F.col(predicted))
    parts = F.when(hit, F.array(F.struct(F.col(gold).alias("class"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(
        F.array(F.struct(F.col(predicted).alias("class"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")), F.struct(F.col(gold).alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    )
    counted = rows.select(F.inline(parts)).groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    return counted.select("*", F.round(ratio(tp, tp + fp), 6).alias("precision_"), F.round(ratio(tp, tp + fn), 6).alias("recall_"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    """Unweighted means over the classes of per_class."""
    return scores.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision_", "recall_", "f1")), F.count("*").alias("classes"))


def probability_scores(rows: DataFrame, p: str, y: str) -> DataFrame:
    """brier, log_loss (probabilities kept EPS from 0 and 1), n."""
    kept = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    loss = -F.when(F.col(y) == 1, F.ln(kept)).otherwise(F.ln(1 - kept))
    return rows.agg(F.round(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"), F.count("*").alias("n"))


def _prf(counted: DataFrame, *keep: str) -> DataFrame:
    tp, fp, fn = F.col("tp").cast("double"), F.col("fp"), F.col("fn")
    return counted.select(*keep, F.round(ratio(tp, tp + fp), 6).alias("precision_"), F.round(ratio(tp, tp + fn), 6).alias("recall_"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def binary(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """precision_, recall_, f1 of boolean columns; 0 where undefined."""
    g, p = F.col(gold), F.col(predicted)
    return _prf(rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")))


def fields(rows: DataFrame, gold: dict[str, Column], predicted: dict[str, Column]) -> DataFrame:
    """tp, fp, fn, f1 over all fields; values are compared trimmed and in lower case, and a mismatch counts as both errors."""
    plain = lambda c: F.lower(F.trim(c))
    pairs = F.array(*(F.struct(plain(g).alias("g"), plain(predicted[name]).alias("p")) for name, g in gold.items()))
    exploded = rows.select(F.inline(pairs))
    g, p = F.col("g"), F.col("p")
    counted = exploded.agg(F.count_if(g == p).alias("tp"), F.count_if(p.isNotNull() & ~g.eqNullSafe(p)).alias("fp"), F.count_if(g.isNotNull() & ~g.eqNullSafe(p)).alias("fn"))
    return _prf(counted, "tp", "fp", "fn").drop("precision_", "recall_")
