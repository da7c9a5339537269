"""A text's style as 32 numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS, MARKS = "etaoinsh", (".", ",", "!", "?", ";", ":", "—", "(")
# Common English words.
COMMON = ("the", "a", "an", "and", "or", "but", "of", "to", "in", "is", "it", "that", "for", "on", "with", "as", "be", "this", "by", "at", "are", "was", "were", "i", "you", "he", "she", "they", "we")
#: Letters and digits, with apostrophes, underscores and hyphens inside.
WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}'_-]*[\p{L}\p{N}])?"
NAMES = (
    *(f"letter_{c}" for c in LETTERS), "stops", "commas", "exclamations", "questions", "semicolons", "colons", "dashes", "parentheses", "word_length", "sentence_length", "type_token", "long_words", "shouted", "capitalised", "digits", "urls",
    "pictographs", "question_rate", "exclamation_rate", "paragraphs", "syllables", "common_words", "once_only", "readability",
)


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)


def vectors(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and NAMES for whole texts; null counts as empty, of which all rates are 0 and the readability is that of no words.

    Letters are shares of the characters, marks and line ends are per 100 of them, links per 100 words. All
    of it is column functions, so nothing leaves the scan.
    """
    text, low = F.col("_t"), F.lower("_t")
    base = rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).select(id_col, "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"))
    base = base.select("*", F.array_sort(F.transform("_w", lambda w: F.lower(w))).alias("_s"), F.greatest(F.lit(1), F.length("_t")).alias("_n"), F.greatest(F.lit(1), F.size("_w")).alias("_k"))
    ends = F.filter(F.split("_t", r"[.!?]+\s+"), lambda x: x != "")
    syllables = F.aggregate("_s", F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))
    length = F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w))
    alone = lambda x, i: (F.coalesce(F.get("_s", i - 1) != x, F.lit(True)) & F.coalesce(F.get("_s", i + 1) != x, F.lit(True))).cast("int")
    once = F.aggregate(F.transform("_s", alone), F.lit(0), lambda a, x: a + x)
    base = base.select("*", F.greatest(F.lit(1), F.size(ends)).alias("_e"), (syllables / F.col("_k")).alias("_y"), length.alias("_l"), F.size(F.array_distinct("_s")).alias("_v"), once.alias("_o"))
    n, k, e = F.col("_n"), F.col("_k"), F.col("_e")
    share = lambda test: F.size(F.filter("_w", test)) / k
    flesch = 206.835 - 1.015 * (k / e) - 84.6 * F.col("_y")
    found = (
        *(_count(low, c) / n for c in LETTERS), *(_count(text, c) / n * 100 for c in MARKS), F.col("_l") / k, k / e, F.col("_v") / k, share(lambda w: F.length(w) >= 7), share(lambda w: (w == F.upper(w)) & w.rlike("[A-Z]")), share(lambda w: w.rlike("^[A-Z]")),
        F.regexp_count(text, F.lit("[0-9]")) / n, F.regexp_count(text, F.lit("https?://")) / k * 100, F.regexp_count(text, F.lit(r"[\x{1F301}-\x{10FFFF}]")) / n, _count(text, "?") / e, _count(text, "!") / e, _count(text, "\n") / n * 100, F.col("_y"),
        share(lambda w: F.lower(w).isin(*COMMON)), F.col("_o") / F.greatest(F.lit(1), F.col("_v")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), flesch / 100)),
    )
    return base.select(id_col, *(c.cast("double").alias(name) for name, c in zip(NAMES, found, strict=True)))


def likeness(a: str, b: str) -> Column:
    """The cosine of two sides' vectors, structs of NAMES; 0 where one has no length."""
    dot = lambda x, y: reduce(lambda p, q: p + q, (F.col(f"{x}.{c}") * F.col(f"{y}.{c}") for c in NAMES))
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
