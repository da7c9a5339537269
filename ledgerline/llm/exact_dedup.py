"""Exact duplicates through an index of live contents kept by cuckoo filters.

The index is a table laid out by bucket of the digest: one row for each bucket's filter and
one for each live content (its digest, length and second hash, its smallest
document id and number of copies). A batch of insertions and deletions is a shuffle
of narrow rows to the buckets, where each task streams over its bucket: a miss in
the filter is new content, a hit is verified against the bucket's contents, an
overflow rebuilds a larger filter from the stored keys. The index knows which table holds each bucket's
rows, so a batch reads the files of the buckets that it touches, and writes only those anew. Copies within an input partition
are combined before the shuffle, so a text that makes up a third of all rows sends
one row per input partition. The number of buckets follows the number of rows that are expected, and when
a bucket outgrows its task later, every bucket is split in two from the stored keys.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, fresh, stage, table, text_or_empty

#: Live contents a bucket is meant to hold: some 30 MB in a task.
BUCKET_ROWS = 100_000
#: Tables over which the buckets may be spread before they are written as one again.
COMPACT = 8
INDEX = "bucket int, filter binary, digest binary, keep_id long, group_size long"
_FILTER, _STORED, _DELETE, _INSERT = 0, 1, 2, 3


def normalised(text_col: str = "text") -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the normalised text, in hexadecimal."""
    return F.sha2(normalised(text_col), 256)


def content_key(text_col: str = "text") -> Column:
    """44 bytes for a normalised text: its SHA-256, its length in bytes, and another hash of it."""
    text = normalised(text_col)
    return F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def _apply(batches):
    """Streams rows sorted by bucket and kind through LiveDigests; yields the new index rows."""
    from .cuckoo import LiveDigests

    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def rows(bucket, live):
        yield bucket, live.filter.table.tobytes(), None, None, None
        for digest, doc_id, n in live:
            yield bucket, None, digest, doc_id, n

    def out(found):
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    at, live = None, None
    for batch in batches:
        for bucket, kind, digest, doc_id, n, bits in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "digest", "doc_id", "n", "filter")), strict=True):
            if bucket != at:
                if live is not None:
                    yield out(rows(at, live))
                at, live = bucket, LiveDigests()
            if kind == _FILTER:
                live = LiveDigests(bits)
            elif kind == _STORED:
                live.load(digest, doc_id, n)
            elif kind == _DELETE:
                live.delete(digest)
            else:
                live.insert(digest, doc_id, n)
    if live is not None:
        yield out(rows(at, live))


class DigestIndex:
    """A table of live contents. Each change gives a new one; earlier ones stay readable.

    parts: tables laid out by bucket, and the buckets whose current rows are in each.
    """

    def __init__(self, spark: SparkSession, buckets: int, parts: tuple[tuple[DataFrame, frozenset[int]], ...] = ()):
        self.spark, self.buckets, self.parts = spark, buckets, parts

    @staticmethod
    def empty(spark: SparkSession, rows_expected: int) -> DigestIndex:
        return DigestIndex(spark, max(1, math.ceil(rows_expected / BUCKET_ROWS)))

    def _of(self, wanted: frozenset[int] | None = None) -> DataFrame:
        """Rows of the wanted buckets, or of all; the files of others are not read."""
        here = [(t, b if wanted is None else b & wanted) for t, b in self.parts]
        found = [t.filter(F.col("bucket").isin(sorted(b))) for t, b in here if b]
        names = [c.split()[0] for c in INDEX.split(", ")]
        return reduce(DataFrame.unionByName, found).select(*names) if found else self.spark.createDataFrame([], INDEX)

    @property
    def rows(self) -> DataFrame:
        return self._of()

    def _bucket(self) -> Column:
        return F.pmod(F.conv(F.substring(F.hex("digest"), 41, 12), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def _deal(self, rows: DataFrame) -> DataFrame:
        """A table of what the rows (bucket, kind, digest, doc_id, n, filter) make of their buckets."""
        dealt = rows.repartitionById(self.buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind", "digest", "doc_id")
        return stage(dealt.mapInArrow(_apply, INDEX), "digest-index", by=("bucket",))

    def change(self, insert: DataFrame | None = None, delete: DataFrame | None = None) -> DigestIndex:
        """insert: (doc_id, digest); delete: (digest), as content_key gives them. Deletions come first; absent ones do nothing."""
        none, changes = F.lit(None).cast("binary").alias("filter"), []
        if delete is not None:
            changes.append(delete.select("digest").distinct().select(self._bucket().alias("bucket"), F.lit(_DELETE).alias("kind"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), none))
        if insert is not None:
            # Copies meet first within an input partition; the filter joins those of different ones.
            near = insert.withColumn("part", F.spark_partition_id()).groupBy("digest", "part").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
            changes.append(near.select(self._bucket().alias("bucket"), F.lit(_INSERT).alias("kind"), "digest", "doc_id", "n", none))
        if not changes:
            return self
        new, touched = reduce(DataFrame.unionByName, changes), frozenset(range(self.buckets))
        if self.parts:
            new = stage(new, "digest-changes")
            touched = frozenset(r.bucket for r in new.select("bucket").distinct().collect())  # one row for each bucket at most
            if not touched:
                return self
        stored = self._of(touched).select("bucket", F.when(F.col("digest").isNull(), _FILTER).otherwise(_STORED).alias("kind"), "digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("n"), "filter")
        table = self._deal(stored.unionByName(new) if self.parts else new)
        parts = (*((t, b - touched) for t, b in self.parts if b - touched), (table, touched))
        changed = DigestIndex(self.spark, self.buckets, parts)
        if self.parts:  # the first batch's rows are those that the number of buckets was made for
            fullest = table.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
            while fullest > 2 * BUCKET_ROWS:
                changed, fullest = changed.split(), fullest / 2
        return changed.compacted() if len(changed.parts) > COMPACT else changed

    def split(self) -> DigestIndex:
        """Twice as many buckets: each one's contents fall into two, whose filters are made anew from the stored keys."""
        twice = DigestIndex(self.spark, 2 * self.buckets)
        kept = self.rows.filter("digest is not null").select(twice._bucket().alias("bucket"), F.lit(_INSERT).alias("kind"), "digest", F.col("keep_id").alias("doc_id"), F.col("group_size").alias("n"), F.lit(None).cast("binary").alias("filter"))
        return DigestIndex(self.spark, twice.buckets, ((twice._deal(kept), frozenset(range(twice.buckets))),))

    def compacted(self) -> DigestIndex:
        """All buckets in one table."""
        table = stage(self.rows.repartitionById(self.buckets, F.col("bucket")), "digest-index", by=("bucket",))
        return DigestIndex(self.spark, self.buckets, ((table, frozenset(range(self.buckets))),))

    def live(self) -> DataFrame:
        """digest, keep_id, group_size."""
        return self.rows.filter(F.col("digest").isNotNull()).select("digest", "keep_id", "group_size")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest (content_key), keep_id, group_size, first: one row per document; first numbers rows that repeat an id and a text."""
    digests = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), content_key(text_col).alias("digest")), "digests")
    index = DigestIndex.empty(docs.sparkSession, digests.count()).change(insert=digests)
    again = Window.partitionBy("doc_id", "digest").orderBy("digest")
    return digests.withColumn("again", F.row_number().over(again)).join(index.live(), "digest")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of rows that repeat an id and a text only one is
    kept. Null ids lose to any other id; a group of null ids only keeps one of its
    rows. An empty table gives an empty result; other columns are ignored. Texts of any
    length are hashed where they are read and never leave their task.
    """
    return _marked(docs, id_col, text_col).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"),
        F.lower(F.substring(F.hex("digest"), 1, 64)).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first row, by id, of each group of equal texts; same columns.

    Null texts count as empty and null ids as the last; of rows that repeat an id and a text one stays. An
    empty table stays empty; columns of any name may stand beside. Texts go through one shuffle: rows meet
    the ids that stay, and are told apart from their repeats, by one key of id and content.
    """
    key, again, kept_key = fresh("content", docs), fresh("again", docs), fresh("kept_content", docs)
    # Never null, so that no filter computes the digests once more.
    of = lambda doc_id, digest: F.coalesce(F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary")), F.lit("").cast("binary"))
    found = _marked(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1))
    kept = found.select(of(F.col("doc_id"), F.col("digest")).alias(kept_key))
    rows = docs.withColumn(key, of(F.col(id_col).cast("long"), content_key(text_col)))
    joined = rows.join(kept, F.col(key) == F.col(kept_key), "left_semi")
    # A running count needs no order within a key, so the join's order serves.
    so_far = F.count(F.lit(1)).over(Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn(again, so_far).filter(F.col(again) == 1).select(*docs.columns)


def op4_exact_dedup(spark, sf_dir):
    return mark_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
