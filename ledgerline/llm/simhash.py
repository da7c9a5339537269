"""Near duplicates by SimHash fingerprints, linked through multi-index hashing.

1. One pass over whole texts makes a 64-bit fingerprint of each document: the majority of each bit over
   the XXH64 hashes of its word shingles, repeats included.
2. Equal fingerprints are one vertex with its smallest doc_id, counted before the shuffle, so that a hot
   text is one row from then on.
3. A fingerprint is cut into segments with a table each. Of two fingerprints within `bits` of each other,
   some segment differs in at most bits // segments, and but for the first bits % segments + 1 segments in one less
   (all others would have to differ in more). So each fingerprint looks into a segment's table with the
   values of a small Hamming ball around its own. The one of a pair that holds 0 at their highest differing bit finds
   the other, so only the values above its own are looked up: half of the ball.
4. Whole distances of what meets in a cell of a table are verified, and those within `bits` are links.
5. Cells above LIMIT fingerprints would meet in too many pairs. Their fingerprints are spelled out in whole instead: each
   posts the values of a ball of half the distance around all its 64 bits. Two meet at a value exactly
   if they are linked, so the least one there stands for all, and a dense cell costs time in proportion to its size.
   No link is lost.
6. Components of the links take the smallest doc_id of their fingerprints.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table
from .near_dedup import components
from .wordhash import LOWER

#: Words of a shingle, differing bits of a link, tables, fingerprints of a cell that are compared in pairs.
WORDS, BITS, SEGMENTS, LIMIT = 3, 2, 2, 64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory than its words.
AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned; a text of fewer words is one shingle, and one without words has fingerprint zero."""
    import xxhash

    found = (text or b"").translate(LOWER).split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(islice(found, k, None) for k in range(min(words, len(found))))))
    ones, n = np.zeros(64, np.int64), 0
    while some := list(islice(shingles, AT_ONCE)):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in some), "<u8", len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a signed long) for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, print long")


def ball(width: int, radius: int) -> list[int]:
    """Masks of one to radius bits among width, as signed 64-bit values."""
    masks = [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _masks(width: int, radius: int) -> Column:
    return F.array(*(F.lit(m).cast("long") for m in ball(width, radius)))


def cells(prints: DataFrame, bits: int, segments: int) -> DataFrame:
    """cell, print, home: the cell of each segment's table that holds the print (home), and those of the ball around it."""
    if not 2 <= segments <= 32:
        raise ValueError("a fingerprint has 2 to 32 segments")
    parts = []
    for s in range(segments):
        low, high = 64 * s // segments, 64 * (s + 1) // segments
        radius = bits // segments - (s > bits % segments)
        if radius < 0:
            continue
        value = F.shiftrightunsigned("print", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        at = lambda v, home: F.struct(F.shiftleft(F.lit(s).cast("long"), 32).bitwiseOR(v).alias("cell"), F.lit(home).alias("home"))  # noqa: B023, E731
        own = F.array(at(value, True))
        if radius:
            around = F.filter(F.transform(_masks(high - low, radius), lambda m: value.bitwiseXOR(m)), lambda v: v > value)  # noqa: B023
            own = F.concat(own, F.transform(around, lambda v: at(v, False)))  # noqa: B023
        parts.append(own)
    return prints.select("print", F.explode(F.concat(*parts)).alias("c")).select("c.cell", "print", "c.home")


def links(prints: DataFrame, bits: int = BITS, segments: int = SEGMENTS, limit: int = LIMIT) -> DataFrame:
    """a, b of distinct prints: pairs within so many bits, whose components are those of all such pairs.

    prints: a column print without repeats. Cells of up to limit prints give every pair that meets there, larger ones a
    chain of pairs through the least print of each shared value.
    """
    rows = stage(cells(prints, bits, segments), "sim-cells")
    n = F.count("*")
    sizes = rows.groupBy("cell").agg(n.alias("n"), F.max("home").alias("used")).filter("used and n > 1")
    met = stage(rows.join(sizes.select("cell", (F.col("n") > limit).alias("dense")), "cell"), "sim-met")

    few = met.filter("not dense")
    home = few.filter("home").select("cell", F.col("print").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    # At home both of a pair have the value, so the lesser asks; elsewhere the ball has one of the two ask.
    pairs = few.select("cell", F.col("print").alias("a"), F.col("home").alias("mine")).join(home, "cell").filter((~F.col("mine") | (F.col("a") < F.col("b"))) & near).select("a", "b")

    dense = met.filter("dense").select("print").distinct()
    wide, narrow = (bits + 1) // 2, bits // 2  # a ball of each around two prints meets exactly if they are within bits
    values = dense.select("print", F.explode(F.concat(F.array(F.lit(0).cast("long")), _masks(64, wide))).alias("mask")).select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("value"), (F.bit_count("mask") <= narrow).alias("close"))
    if wide == 0:
        return pairs.distinct()
    values = stage(values, "sim-values")
    least = values.groupBy("value").agg(F.min(F.when(F.col("close"), F.col("print"))).alias("least"), n.alias("n")).filter("n > 1 and least is not null").select("value", "least")
    chained = values.join(least, "value").filter("print <> least").select(F.col("print").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(chained).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, words: int = WORDS, bits: int = BITS, segments: int = SEGMENTS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, its own included).

    Null and empty texts and those of white space have fingerprint zero and are linked like any other. Rows that repeat
    an id have a row each; a null id counts for no component's smallest, and a component of null ids alone has
    none. A very long text is hashed in parts by one task; an empty table gives an empty result; other
    columns, of whatever name, are ignored.
    """
    rows = stage(fingerprints(docs, words, id_col, text_col), "sim-prints")
    prints = stage(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "sim-distinct")
    labels = components(links(prints.select("print"), bits, segments, limit))
    marked = stage(prints.join(labels, F.col("print") == F.col("v"), "left").select("print", "first", "label"), "sim-labels")
    linked = marked.filter("label is not null")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = linked.join(smallest, "label").select("print", "component_id").unionByName(marked.filter("label is null").select("print", F.col("first").alias("component_id")))
    return rows.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))
