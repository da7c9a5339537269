"""Token-id files: one zstandard frame per document under a shared dictionary.

The dictionary is trained once on the serialized ids of a bounded sample. Tasks
then encode whole texts and compress each document on its own. A range shuffle
of the small frames (not of texts) puts them in id order, and each task writes
blocks: concatenated frames, their byte offsets, the ids they belong to, the
dictionary's hash and the number of tokens before the block in its shard. Blocks
are rows of a Parquet table, so that Spark's committer makes the write atomic on
any store, and min/max statistics of first_id and last_id let a reader fetch one
block and inflate one frame for one document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage, table
from .tokens import encoder, slices

#: Documents that the dictionary is trained on, about; the most bytes of the ids of one; the dictionary's bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 16 << 10, 64 << 10
BLOCK_DOCS, BLOCK_BYTES = 1_024, 1 << 20
LEVEL = 3
BLOCKS = "shard int, block int, first_id long, last_id long, tokens_before long, n_tokens long, dictionary_hash string, doc_ids array<long>, offsets array<long>, lengths array<long>, frames binary"
ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((c, pa.int64()) for c in ("first_id", "last_id", "tokens_before", "n_tokens")), ("dictionary_hash", pa.string()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "offsets", "lengths")), ("frames", pa.binary())])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty if there is too little to learn from; a few samples serve as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-size:]
        return raw if len(raw) >= 8 else b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _dictionary(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _encode(tokenizer: str, end: int | None, dictionary: bytes | None):
    """(doc_id, text) -> (doc_id, n_tokens, frame); without a dictionary the frame is the first SAMPLE_BYTES of the plain ids."""

    def run(batches):
        import zstandard

        coder = encoder(tokenizer)
        tail = b"" if end is None else np.array([end], coder.dtype).tobytes()
        press = None if dictionary is None else zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        width = np.dtype(coder.dtype).itemsize
        for batch in batches:
            for part in slices(batch):
                ids = [x + tail for x in coder.encode(part.column("text"))]
                frames = [x[:SAMPLE_BYTES] for x in ids] if press is None else [press.compress(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"])

    return run


def _blocks(hash_: str):
    """Rows in order -> blocks of one shard, which is the partition."""

    def run(batches):
        from pyspark import TaskContext

        shard, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, lengths, frames = [], [], []

        def flush():
            nonlocal block, before, ids, lengths, frames
            known = [i for i in ids if i is not None]
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            row = [shard, block, min(known, default=None), max(known, default=None), before, sum(lengths), hash_, ids, offsets, lengths, b"".join(frames)]
            block, before, ids, lengths, frames = block + 1, before + sum(lengths), [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, ARROW.types, strict=True)], schema=ARROW)

        for batch in batches:
            for i, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True):
                ids.append(i)
                lengths.append(n)
                frames.append(frame)
                held += len(frame)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    held = 0
                    yield flush()
        if ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/dictionary and path/blocks.

    Null texts count as empty, null ids come first, rows that repeat an id each
    have an entry, an empty table gives no blocks. Other columns are ignored. A
    long text is one frame: a task holds it, its ids and a few MB of others. The
    dictionary's sample is drawn by a hash of each row's id and place, so its
    expected size is SAMPLE rows whatever ids repeat, SAMPLE_BYTES of each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)))
    plain = sample.mapInArrow(_encode(tokenizer, end, None), "doc_id long, n_tokens long, frame binary")
    dictionary = train_dictionary([bytes(r.frame) for r in plain.select("frame").collect()])
    hash_ = dictionary_hash(dictionary)
    docs.sparkSession.createDataFrame([(hash_, bytearray(dictionary))], "hash string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = stage(rows.mapInArrow(_encode(tokenizer, end, dictionary), "doc_id long, n_tokens long, frame binary").withColumn("ordinal", F.monotonically_increasing_id()), "frames", "none")
    order = ["doc_id", "n_tokens", "ordinal"]
    frames.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(hash_), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _load_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if dictionary_hash(bytes(row.content)) != row.hash:
        raise ValueError(f"the dictionary in {path} does not match its hash")
    return bytes(row.content)


def _checksum(ids: bytes, dtype: str) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())


def _inflate(dictionary: bytes, hash_: str, wanted: frozenset | None = None, checksum: str | None = None):
    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["dictionary_hash"] != hash_:
                    raise ValueError("a block was written with another dictionary")
                frames, cuts = row["frames"], row["offsets"]
                found = [k for k, i in enumerate(row["doc_ids"]) if wanted is None or i in wanted]
                starts = row["tokens_before"] + np.concatenate([[0], np.cumsum(row["lengths"])])
                ids = (press.decompress(frames[cuts[k] : cuts[k + 1]]) for k in found)
                last = pa.array(list(ids), pa.binary()) if checksum is None else pa.array([_checksum(x, checksum) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"][k] for k in found], pa.int64()), pa.array([row["shard"]] * len(found), pa.int32()), pa.array([int(starts[k]) for k in found], pa.int64()), pa.array([row["lengths"][k] for k in found], pa.int64()), last],
                    ["doc_id", "shard", "start_in_shard", "n_tokens", "ids" if checksum is None else "ids_crc32"],
                )

    return run


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, checksum: str | None = None) -> DataFrame:
    """doc_id, shard, start_in_shard, n_tokens, ids (serialized), from the files.

    doc_ids: only those documents; other blocks are skipped by statistics and
    other frames are not inflated. checksum: the type of the stored ids ("<u2");
    then ids_crc32, of the ids as 32-bit integers, stands in place of ids.
    """
    dictionary = _load_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if doc_ids is not None:
        hit = F.lit(False)
        for i in doc_ids:
            hit = hit | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.filter(hit)
    return blocks.mapInArrow(_inflate(dictionary, dictionary_hash(dictionary), None if doc_ids is None else frozenset(doc_ids), checksum), f"doc_id long, shard int, start_in_shard long, n_tokens long, {'ids binary' if checksum is None else 'ids_crc32 long'}")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, tokens_before: one row per shard, from the narrow columns of the blocks."""
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tokens_before"))


def op3_token_files(spark, sf_dir):
    import uuid

    path, tokenizer = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", "word_bpe_49k.json"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer, end=2)
    # One row per shard, of which there are as many as shuffle partitions.
    read = read_token_files(spark, path, checksum=encoder(tokenizer).dtype).join(F.broadcast(shard_starts(spark, path)), "shard")
    return read.select("doc_id", (F.col("tokens_before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
