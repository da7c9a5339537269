"""Contiguous shards of equal bytes by global prefix sums.

Rows are put in id order by a range shuffle of narrow rows (never the texts).
Each partition's byte and row totals form a small table whose prefix sums give
every partition its global offset; a running sum inside the partition then gives
each row its global first byte, and equal cuts of the total give the shard. No
task sees more than one range partition, and a hot id is split by a row ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    size is the UTF-8 length plus 1, so a null or empty text counts 1. Order is
    by id (nulls first), then size, then checksum; repeated rows are
    interchangeable. A document belongs to the shard that holds its first byte.
    An empty table gives an empty result; other columns of docs are ignored. A text
    of any length is one row of its size and checksum; it never moves.
    """
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("ordinal"),
    )
    order = ["doc_id", "size", "text_crc32", "ordinal"]
    placed = stage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-keys")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    # One row per range partition: its size is the number of shuffle partitions.
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    located = stage(placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.count("*").over(inside)).alias("row"),
        F.least(
            F.floor((F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))) * F.lit(float(shards)) / F.col("total")),
            F.lit(shards - 1),
        ).cast("int").alias("shard"),
    ), "shard-located")
    # At most one row per shard.
    first = located.groupBy("shard").agg(F.min("row").alias("first_row"))
    return located.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )


def op9_sharding(spark, sf_dir):
    from .common import table

    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP9_SQL = r"""
WITH t AS (SELECT list(b ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS b FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
h AS (SELECT doc_id, size, hex(encode(text)) AS h FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, t),
o AS (SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT doc_id, size, text_crc32, CAST(least(7, floor(coalesce(before, 0) * 8.0 / total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
