"""Document quality without gold labels: overlapping heuristics, their accuracies, a scorer.

1. Labellers each vote bad, good or nothing on a whole text. Spark counts the
   patterns of votes over all documents, a table of at most 3 ** labellers rows.
2. Expectation-maximisation on those counts estimates how each labeller votes on
   good and on bad documents, and so every pattern's posterior. The counts are
   sufficient, so this is exact for the whole table.
3. On a bounded sample the posteriors, as soft labels, train a logistic scorer
   over hashed character-shape trigrams; it generalises to texts on which no
   labeller votes. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .ftrl import Ftrl, mixed, sigmoid
from .wordhash import mix

BAD, GOOD, NONE = 0, 1, 2
#: (name, bad where the measure is beyond, good where it is within). Measures are per word or shares.
LABELLERS = (
    ("symbols", 0.30, 0.02),  # characters other than letters, digits and common marks
    ("marks", 0.60, 0.30),  # marks of any kind
    ("shouting", 0.40, 0.15),  # upper case among ASCII letters
    ("exclaiming", 0.15, 0.01),  # runs of exclamation marks
    ("bars", 0.15, 0.01),  # vertical bars
    ("stutter", 0.20, 0.02),  # words equal to the one before
    ("monotony", 0.75, 0.55),  # words that are not new to the text
    ("redundancy", 0.80, 0.70),  # what compression saves
    ("lines", 0.50, 0.05),  # lines that are not new to the text
)
#: Words below which a measure says nothing.
LEAST = {"marks": 12, "monotony": 20, "redundancy": 40, "shouting": 3}
UPPER, LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COMMON = b".,;:!?'\"()-"
ODD = bytes(c for c in MARKS if c not in COMMON)

DIM_BITS = 16
#: Words in which a repeated word counts as one.
WINDOW = 200
TRAIN, SHARD_ROWS, EPOCHS = 12_000, 3_000, 8
THRESHOLD = 0.5


def votes(text: bytes | None) -> int:
    """The pattern of votes as a base-3 number, labeller i at 3 ** i."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return sum(NONE * 3**i for i in range(len(LABELLERS)))
    without = lambda chars: len(text) - len(text.translate(None, chars))
    letters, lines = without(LETTERS), [x for x in text.split(b"\n") if x]
    measures = (
        without(ODD) / n,
        without(MARKS) / n,
        without(UPPER) / max(1, letters),
        text.count(b"!!") / n,
        text.count(b"|") / n,
        sum(map(operator.eq, words, words[1:])) / n,
        # A long text repeats words as a matter of course.
        max(0.0, 1 - len(set(words)) / n - 0.02 * max(0, n.bit_length() - 8)),
        1 - len(zlib.compress(text, 1)) / len(text),
        1 - len(set(lines)) / max(1, len(lines)),
    )
    pattern = 0
    for i, ((name, bad, good), m) in enumerate(zip(LABELLERS, measures, strict=True)):
        vote = NONE if n < LEAST.get(name, 1) else BAD if m > bad else GOOD if m <= good else NONE
        pattern += vote * 3**i
    return pattern


@dataclass
class LabelModel:
    """prior: share of good documents; rates[labeller][class][vote] of the votes that are cast."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that documents with these patterns are good; a missing vote tells nothing."""
        digits = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
        silent = np.zeros((len(LABELLERS), 2, 1))
        log = np.concatenate([np.log(self.rates), silent], axis=2)[np.arange(len(LABELLERS))[None, :], :, digits].sum(axis=1)
        log = log + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller's votes, the share that is right."""
        right = self.rates[:, BAD, BAD] * (1 - self.prior) + self.rates[:, GOOD, GOOD] * self.prior
        return {name: float(r) for (name, _, _), r in zip(LABELLERS, right, strict=True)}


#: Where EM starts: votes that are expected of a labeller on bad and on good documents, and the share of good ones. They
#: say which class is which, and weigh as much as PRIOR_ROWS documents, so that a table of a few has a model too.
EXPECTED, PRIOR, PRIOR_ROWS = ((0.4, 0.6), (0.01, 0.99)), 0.85, 10.0


def fit_label_model(counts: dict[int, int], rounds: int = 500) -> LabelModel:
    """EM on pattern counts: every labeller's rates on both classes, and the classes' shares, are estimated and not bounded."""
    patterns, n = np.array(list(counts), np.int64), np.array(list(counts.values()), float)
    expected = np.array(EXPECTED)
    model = LabelModel(PRIOR, np.repeat(expected[None], len(LABELLERS), axis=0))
    if not len(n):
        return model
    total, digits = n.sum(), (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    pseudo = PRIOR_ROWS * expected * np.array([1 - PRIOR, PRIOR])[:, None]
    for _ in range(rounds):
        good = model.posterior(patterns)
        split = np.stack([n * (1 - good), n * good])
        rates = np.stack([[[split[c][digits[:, i] == v].sum() for v in (BAD, GOOD)] for c in (BAD, GOOD)] for i in range(len(LABELLERS))]) + pseudo
        rates = rates / rates.sum(axis=2, keepdims=True)
        new = LabelModel(float((split[GOOD].sum() + PRIOR * PRIOR_ROWS) / (total + PRIOR_ROWS)), rates)
        done = abs(new.prior - model.prior) < 1e-9 and np.abs(new.rates - model.rates).max() < 1e-9
        model = new
        if done:
            break
    return model


SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))


def repeat_share(words: list[bytes]) -> float:
    """The share of words that are not new to their window, over all windows of WINDOW consecutive words (or the one shorter)."""
    n, size = len(words), min(len(words), WINDOW)
    last, new = {}, 0
    for i, word in enumerate(words):
        # The word at i is new to the windows that start after its last place and reach i.
        first, final = max(last.get(word, -1), i - size), min(i, n - size)
        last[word] = i
        if final > first:
            new += final - first
    return 1 - new / (size * (n - size + 1)) if n else 0.0


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates and values: the bias, shares of shape trigrams and of repeated words.

    A shape writes letters, digits and spaces each as one class and a run of one
    class once. Values are roots of shares, so a text's length does not matter; repeats
    are those of windows of equal length, over the whole text.
    """
    text = text or b""
    shape = np.frombuffer(text.translate(SHAPE), np.uint8)
    shape = np.concatenate([[32], shape[np.flatnonzero(np.diff(shape, prepend=shape[:1] ^ 1))], [32]]).astype(np.uint64)
    grams = shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:]
    code, n = np.unique(grams, return_counts=True)
    words = text.split()
    named = {k: sum(map(operator.eq, words, words[k:])) / max(1, len(words)) for k in (1, 2)} | {3: repeat_share(words)}
    extra = [(k, v) for k, v in named.items() if v]
    keys = np.concatenate([code, np.array([k + (1 << 32) for k, _ in extra], np.uint64)])
    x = np.sqrt(np.concatenate([n / max(1, n.sum()), np.array([v for _, v in extra])]))
    at = (mix(keys.astype(np.uint64)) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
    at, where = np.unique(np.where(at == 0, 1, at), return_inverse=True)
    return np.append(at, 0), np.append(np.bincount(where, x, len(at)), 1.0)


def _patterns(batches):
    counts: dict[int, int] = {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            p = votes(text)
            counts[p] = counts.get(p, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["pattern", "n"])


def _train(model: LabelModel):
    def run(batches):
        rows = []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and text.split():
                    rows.append((*features(text), float(model.posterior(np.array([votes(text)]))[0])))
        if rows:
            at, w = Ftrl(1 << DIM_BITS, alpha=1.0, l1=0.1, l2=0.01).fit(rows, EPOCHS, 1)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64()))], ["n", "at", "w"])

    return run


@dataclass
class QualityModel:
    labels: LabelModel
    weights: dict[int, float]


def train_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """The label model of all rows, and a scorer from about TRAIN of them, drawn by a hash of each row's id and place.

    Null and empty texts cast no vote and train nothing; an empty table gives the model's priors and a scorer without weights.
    Texts that repeat count as often as they stand; ids may repeat or be null; other columns are ignored. Votes
    and features are of whole texts; of a sampled text only its features, bounded by DIM_BITS, are held.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counts = texts.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in counts)
    labels = fit_label_model({r.pattern: r.n for r in counts})
    share = min(1.0, TRAIN / max(1, total))
    place = F.xxhash64("doc_id", F.monotonically_increasing_id())
    chosen = texts.withColumn("place", place).filter(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)))
    shards = chosen.repartition(max(1, round(min(total, TRAIN) / SHARD_ROWS)), "place").sortWithinPartitions("doc_id", "place").select("text")
    models = shards.mapInArrow(_train(labels), "n long, at array<long>, w array<double>").collect()
    return QualityModel(labels, mixed(((r.n, r.at, r.w) for r in models), drop=0.0))


def quality(model: QualityModel, text_col: str = "text") -> Column:
    """A struct column (pattern, posterior, score) of a text; score is 0 for a text without words."""

    dense = np.zeros(1 << DIM_BITS, np.float32)  # 256 KB that every task gets once
    dense[list(model.weights)] = list(model.weights.values())

    @F.arrow_udf("struct<pattern: long, posterior: double, score: double>")
    def score(texts: pa.Array) -> pa.Array:
        found, scores = [], []
        for text in texts.to_pylist():
            found.append(votes(text))
            at, x = features(text)
            scores.append(sigmoid(float(dense[at] @ x)) if text and text.split() else 0.0)
        posterior = model.labels.posterior(np.array(found, np.int64)) if found else []
        return pa.StructArray.from_arrays([pa.array(found, pa.int64()), pa.array(posterior, pa.float64()), pa.array(scores, pa.float64())], ["pattern", "posterior", "score"])

    return score(F.col(text_col).cast("binary"))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, pattern, posterior, score, keep.

    Null and empty texts, and texts of white space only, score 0 and are not
    kept. Repeated rows have equal scores, null ids stay null, an empty table
    gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), quality(model, text_col).alias("q"))
    return rows.select("doc_id", "q.pattern", "q.posterior", "q.score").withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least the threshold; same columns, whatever their names.

    Null and empty texts score 0 and go; of rows that repeat, all stay or all go. An empty table stays empty.
    """
    return docs.filter(quality(train_quality(docs, id_col, text_col), text_col)["score"] >= threshold)


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs))
