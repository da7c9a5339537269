"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features are the presence of words, of long words' stems (their first bytes), of
word pairs and of pairs that skip one word, hashed into one space for words and
one for pairs. A bounded, hash-chosen sample of labelled documents is dealt into
shards; each task trains on its shard, and the sparse weights are averaged. The
compact weights are then broadcast and every whole text is scored in one pass
without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .ftrl import Ftrl, mixed, sigmoid
from .wordhash import LOWER, sequence_hashes, word_hashes

WORD_BITS, PAIR_BITS = 21, 22
DIMS = (1 << WORD_BITS) + (1 << PAIR_BITS)
#: Labelled documents the model is trained on, about; rows of a shard, about.
TRAIN, SHARD_ROWS = 20_000, 10_000
EPOCHS, ALPHA, POSITIVE_WEIGHT = 5, 2.0, 4.0
#: Coordinates are learned where so many of a shard's documents have them, and at most such a share.
LEAST_DOCS, MOST_SHARE = 4, 0.3
STEM = 7
THRESHOLD = 0.7
EDGES = b".,;:!?\"'()[]{}<>*-_"
SPANS = ((0,), (0, 1), (0, 2))


def coordinates(text: bytes | None) -> np.ndarray:
    """The coordinate of every word, stem, pair and skipping pair in turn; repeats stay. 0 is the bias."""
    words = [w for x in (text or b"").translate(LOWER).split() if (w := x.strip(EDGES))]
    hashes = word_hashes(words)
    stems = word_hashes([b"^" + w[:STEM] for w in words if len(w) > STEM])
    single = (np.concatenate([hashes, stems]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs = [(sequence_hashes(hashes, s) >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + (1 << WORD_BITS) for s in SPANS[1:]]
    at = np.concatenate([single, *pairs])
    return np.where(at == 0, 1, at)


def _train(batches):
    """One shard's documents (shard, text, label), in order of shard -> its sparse weights."""

    def fit(shard, found):
        df = np.zeros(DIMS, np.int32)
        for at, _ in found:
            df[at] += 1
        known = (df >= LEAST_DOCS) & (df <= MOST_SHARE * len(found))
        known[0] = True
        rows = [(at[known[at]], y) for at, y in found]
        p = sum(y for _, y in rows) / len(rows)
        # What a coordinate that tells nothing gathers by chance over the shard's rows.
        l1 = float(np.sqrt(len(rows) * p * (1 - p)))
        at, w = Ftrl(DIMS, alpha=ALPHA, l1=l1, l2=0.0).fit([(at, np.ones(len(at)), y, POSITIVE_WEIGHT if y else 1.0) for at, y in rows], EPOCHS, shard)
        return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64()))], ["n", "at", "w"])

    current, rows = None, []
    for batch in batches:
        for shard, text, label in zip(*(batch.column(c).to_pylist() for c in ("shard", "text", "label")), strict=True):
            if rows and shard != current:
                yield fit(current, rows)
                rows = []
            current = shard
            rows.append((np.unique(np.append(coordinates(text), 0)).astype(np.int32), float(label)))
    if rows:
        yield fit(current, rows)


def train_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """Sparse weights from labelled documents; labels: id_col and label_col (0, 1, null: unlabelled).

    The sample is chosen by a hash of the labelled ids, which are distinct, to hold about TRAIN rows, so it
    may be broadcast. Labels of an id that repeats are one, the greatest; null ids meet no document. Without labels, or
    without documents, the model is empty and every score is 0.5. Of a long text only its distinct coordinates are held.
    """
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    n = labels.count()
    share, parts = min(1.0, TRAIN / max(1, n)), max(1, round(min(n, TRAIN) / SHARD_ROWS))
    chosen = known.filter(F.pmod(F.xxhash64(id_col, F.lit(10)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen.withColumnRenamed(id_col, "labelled")), F.col("doc_id") == F.col("labelled"))
    # An id that repeats is one sample, of its least text, so that repeats do not fill a shard.
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)).cast("int").alias("shard"), "doc_id", "text", "label")
    shards = rows.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    return mixed((r.n, r.at, r.w) for r in shards.select("shard", "text", "label").mapInArrow(_train, "n long, at array<long>, w array<double>").collect())


def _score(model):
    def run(batches):
        dense = np.zeros(DIMS, np.float32)
        dense[list(model.value)] = list(model.value.values())
        bias = model.value.get(0, 0.0)
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                at = coordinates(text)
                hit = np.unique(at[dense[at] != 0])
                scores.append(sigmoid(bias + float(dense[hit].sum(dtype=np.float64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def score_toxicity(docs: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score.

    Null and empty texts have the score of the bias alone; repeated rows have
    equal scores; null ids are not held out. Other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)  # L1 leaves a few thousand weights
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_score(spread), "doc_id long, held_out boolean, score double")


def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.filter(~held_out()).select("doc_id", "toxic"))
    return score_toxicity(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
