"""Filters, token search and ranking, projections and ladders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .graph import staged

#: What a declarative projection may do to a column.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "titlecase": F.initcap,
    "bool_yn": lambda c: F.when(c.cast("boolean"), "yes").otherwise("no"),
    "first": lambda c: F.element_at(F.split(c, r"[,|]"), 1),
    "pipe_join": lambda c: F.regexp_replace(c, r"\s*,\s*", "|"),
    "digits": lambda c: F.regexp_replace(c, r"\D", ""),
    "e164": tx.phone_key,
}


def project(rows: DataFrame, fields: dict[str, tuple[str | Column, str | None]]) -> DataFrame:
    """Columns by (source, transform) under new names; unknown transforms raise KeyError."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(*((TRANSFORMS[how](column(c)) if how else column(c)).alias(name) for name, (c, how) in fields.items()))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the given conditions, skipping those that are None."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def filters(q: str | None = None, q_columns: tuple[str, ...] = (), one_of: dict[str, list] | None = None, at_least: dict[str, float] | None = None, at_most: dict[str, float] | None = None) -> Column:
    """Optional predicates as one condition; what is None or empty does not filter."""
    return all_of(
        any_of(*(F.lower(c).contains(q.lower()) for c in q_columns)) if q else None,
        *(F.col(c).isin(*values) for c, values in (one_of or {}).items() if values),
        *(F.col(c) >= v for c, v in (at_least or {}).items() if v is not None),
        *(F.col(c) <= v for c, v in (at_most or {}).items() if v is not None),
    )


def json_array(c: Column) -> Column:
    """The elements of a JSON array as strings; an empty array where it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def overlaps(low: str, high: str, from_: float, to: float) -> Column:
    """Whether [low, high] and [from_, to] share a value."""
    return (F.col(high) >= from_) & (F.col(low) <= to)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def tokens_match(tokens: list[str], columns: list[str], most: int = 6) -> Column:
    """Every token occurs in some column; case does not matter."""
    return all_of(*(any_of(*(F.lower(c).contains(x.lower()) for c in columns)) for x in tokens[:most]))


def search_rank(title: Column, body: Column, phrase: str, tokens: list[str]) -> Column:
    """Exact title 500, prefix 400, contained 250, a word's prefix 120; 40 a token in the title, 15 in the body; short titles 50."""
    title, body, phrase = F.lower(title), F.lower(body), phrase.lower()
    base = F.when(title == phrase, 500).when(title.startswith(phrase), 400).when(title.contains(phrase), 250).otherwise(0)
    word = F.when(F.exists(F.split(title, r"\s+"), lambda w: w.startswith(phrase)), 120).otherwise(0)
    hits = [F.when(title.contains(x.lower()), 40).otherwise(0) + F.when(body.contains(x.lower()), 15).otherwise(0) for x in tokens]
    return reduce(lambda a, b: a + b, hits, base + word) + F.when(F.length(title) < 12, 50).otherwise(0)


def ladder(column: Column, steps: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that matches; case does not matter."""
    c = F.lower(column)
    found = F.lit(otherwise)
    for pattern, name in reversed(steps):
        found = F.when(c.rlike(pattern), name).otherwise(found)
    return found


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that holds, null if none does."""
    return F.coalesce(*(F.when(c, reason) for reason, c in checks))


#: Bits of the filter that texts' words pass before they meet spans; its size does not depend on the number of spans.
BITS = 26
#: Bytes of tx.plain_words: letters in lower case, digits, and spaces for all others.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _known_words(kept: np.ndarray):
    """(doc_id, _bytes) -> (doc_id, words): the distinct words of tx.plain_words that pass the filter."""
    flags, mask = kept.tobytes(), (1 << BITS) - 1

    def run(batches):
        for batch in batches:
            words = []
            for text in batch.column("_bytes").to_pylist():
                # The two characters beyond ASCII whose lower case is not: the Kelvin sign, and I with a dot, which stays a mark of its own.
                plain = text.replace(b"\xe2\x84\xaa", b"k").replace(b"\xc4\xb0", b"i ").translate(_PLAIN)
                slots = ((w, crc32(w) & mask) for w in set(plain.split()))
                words.append([w for w, h in slots if flags[h >> 3] >> (h & 7) & 1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["doc_id", "words"])

    return run


def known_words(sources: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, words: of each text the distinct words that are known (w), and by chance a few others, in one pass over the texts."""
    slots = known.select(F.crc32(F.col("w").cast("binary")).bitwiseAND(F.lit((1 << BITS) - 1)).alias("slot"))
    filled = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()  # 2^(BITS - 6) rows at most
    kept = np.zeros(1 << (BITS - 6), "<i8")
    kept[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    raw = sources.select("doc_id", F.col("text").cast("binary").alias("_bytes")).filter("_bytes is not null")
    return raw.mapInArrow(_known_words(kept), f"doc_id {dict(sources.dtypes)['doc_id']}, words array<string>")


def span_candidates(spans: DataFrame, sources: DataFrame, present: float) -> DataFrame:
    """item_id, doc_id: of spans with inner key words, the pairs that may hold; all that do are among them.

    Pairs meet on a span's rarest words. They stay if the text has the share `present` of the span's key words, or all inner
    ones, as a text that contains the span has. That takes a text's known words only, not the text.
    """
    words = staged(known_words(sources, spans.select(F.explode("k").alias("w")).distinct()), "text-words")
    each = words.select("doc_id", F.explode("words").alias("w"))
    # Words of no source are rarest of all; a word's share is that of its repeats too.
    ranked = spans.select("item_id", F.size("k").alias("size"), F.explode("k").alias("w"), "inner").groupBy("item_id", "w").agg(F.first("size").alias("size"), F.count("*").alias("m"), F.max(F.array_contains("inner", F.col("w"))).alias("in"))
    often = staged(each.join(ranked.select("w").distinct(), "w").groupBy("w").agg(F.count("*").alias("n")), "span-words")
    before = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "w").rowsBetween(Window.unboundedPreceding, -1)
    prefix = ranked.join(often, "w", "left").withColumn("sum", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("has", F.coalesce(F.max("in").over(before), F.lit(False)))
    prefix = staged(prefix.filter((F.col("sum") <= F.col("size") * (1 - present) + 1e-6) | ~F.col("has")).select("item_id", "w"), "span-prefixes")
    # Pairs are narrow but work to judge, so AQE must not put them into few tasks by their bytes.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = each.join(prefix, "w").select("item_id", "doc_id").repartition(parts, "doc_id").distinct()
    both = met.join(spans.filter(F.size("inner") > 0), "item_id").join(words, "doc_id")
    held = both.select("item_id", "doc_id", "k", "inner", F.explode(F.array(F.array_intersect("words", "k"))).alias("held"))
    inside = lambda w: F.array_contains("held", w)
    return held.filter((F.size(F.filter("k", inside)) / F.size("k") >= present) | F.forall("inner", inside)).select("item_id", "doc_id").distinct()


def verify_spans(claims: DataFrame, sources: DataFrame, present: float = 0.85, fuzzy: float = 0.7) -> DataFrame:
    """item_id, doc_id, contained, share, score, verified: every source that holds a claim's span, from whole texts.

    claims: item_id, claim, span; sources: doc_id, text. A source holds a span that its normalised
    text contains, or of whose key words (repeated ones count) it has the share `present`. verified:
    the span has all key words of the claim (score 1), or their Jaccard similarity is `fuzzy` at least.

    A source that holds a span has one of any key words that are more than 1 - present of it, if one
    of them is neither the first nor the last word of the span (those may be parts of longer words).
    So pairs meet on a span's rarest such words only, and whole texts are read for those alone that can hold the span. Spans without an
    inner key word are looked for in every source; those without any key word verify nothing and are left out.
    """
    plain = claims.select("item_id", tx.plain_words(F.col("span")).alias("s"), F.array_distinct(tx.key_words(tx.plain_words(F.col("claim")))).alias("c")).filter("s <> ''")
    inner = F.array_distinct(tx.key_words(F.regexp_replace("s", r"^\S+ ?| ?\S+$", "")))
    spans = plain.select("item_id", "s", "c", tx.key_words(F.col("s")).alias("k"), inner.alias("inner"))
    both, either = F.size(F.array_intersect("c", "k")), F.size(F.array_union("c", "k"))
    score = F.when(F.size("c") == 0, 0.0).when(both == F.size("c"), 1.0).otherwise(both / either)
    spans = staged(spans.select("*", score.alias("score")).select("*", ((F.size("c") > 0) & (F.col("score") >= fuzzy)).alias("verified")).drop("c"), "spans")

    plain_text = tx.plain_words(F.col("text")).alias("t")
    by_word = staged(span_candidates(spans, sources, present), "span-pairs").join(sources.select("doc_id", "text"), "doc_id").join(spans, "item_id")
    by_word = by_word.select("item_id", "doc_id", "s", "k", "score", "verified", plain_text)
    bare = spans.filter((F.size("inner") == 0) & (F.size("k") > 0))
    by_text = sources.select("doc_id", plain_text).crossJoin(bare).select(*by_word.columns)
    contained = F.contains("t", "s")
    whole = F.concat(F.lit(" "), "t", F.lit(" "))
    share = F.when(contained, 1.0).otherwise(F.size(F.filter("k", lambda w: F.contains(whole, F.concat(F.lit(" "), w, F.lit(" "))))) / F.size("k"))
    # A generator, so that neither is made again for the filter and for each word.
    judged = F.inline(F.array(F.struct(contained.alias("contained"), share.alias("share"))))
    return by_word.unionByName(by_text).select("item_id", "doc_id", judged, "score", "verified").filter(F.col("share") >= present)
