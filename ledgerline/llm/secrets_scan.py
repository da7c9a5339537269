"""Finds secrets in whole texts: fixed patterns, and random-looking strings by Markov models.

First-order character models of random strings and of ordinary identifiers are
trained from labelled samples as pair counts summed by Spark (a table whose
size depends on the alphabet alone). Ordinary samples are the corpus's own runs; random ones are
what the patterns match there, and strings drawn from each alphabet that keys are written in, a model each, so
that what a corpus happens to hold (hex digests mostly) doesn't make other keys unlikely. A run of identifier characters,
or what the patterns leave of one, is reported where the log-likelihood ratio of the random models, taken as
equally likely, over the ordinary one is high in total and per character; the ratio alone decides, from the
length on that the models learn from. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones fail as a whole
#: Characters of a run that is learnt as random, or scored, at least.
LEAST = 8
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_-]{4,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
STATES = len(ALPHABET) + 1  # 0: start
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: Alphabets that keys are written in, and how many strings of how many characters are drawn from each as samples.
ALPHABETS = {
    "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "url64": UPPER + LOWER + DIGITS + "-_", "base32": UPPER + "234567", "upper36": UPPER + DIGITS, "lower36": LOWER + DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF",
}
DRAWN, DRAWN_LENGTH = 4_000, 24
#: Documents the models are trained on, about.
SAMPLE = 10_000
#: Runs whose ratio a task remembers.
REMEMBERED = 200_000
BACKOFF = 16.0
#: A span's ratio, in nats: in total, and for each character.
TOTAL, PER_CHARACTER = 12.0, 0.6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans, which are sorted, cover together."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _left(start: int, end: int, covered: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """What of a range is not covered; in time logarithmic in the covering spans, but for those that it meets."""
    starts, ends = covered
    left, i = [], bisect_right(ends, start)
    while i < len(starts) and starts[i] < end:
        if starts[i] > start:
            left.append((start, starts[i]))
        start, i = ends[i], i + 1
    if start < end:
        left.append((start, end))
    return left


def _codes(run: str) -> np.ndarray:
    return LUT[np.frombuffer(b"\n" + run.encode("ascii"), np.uint8)]


def labelled_runs(text: str) -> list[tuple[str, bool]]:
    """Weakly labelled samples of a text: what the patterns match, and other runs."""
    base = base_spans(text)
    found = []
    for start, kind, end in base:
        value = text[start:end]
        if kind == 0:
            value = ASSIGN.match(value)[2]
        found += [(x, True) for x in ORDINARY.findall(value) if len(x) >= LEAST]
    covered = _covered(base)
    found += [(m[0], False) for m in ORDINARY.finditer(text) if _left(m.start(), m.end(), covered) == [m.span()]]
    return found


LUT = np.zeros(128, np.int64)  # other characters, a line's end among them, are the start
LUT[[ord(c) for c in ALPHABET]] = range(1, STATES)


def pair_counts(runs: list[str]) -> np.ndarray:
    """How often each character follows each other one, or begins a run."""
    codes = LUT[np.frombuffer(("\n" + "\n".join(runs)).encode("ascii"), np.uint8)]
    pairs = codes[:-1] * STATES + codes[1:]
    return np.bincount(pairs[codes[1:] > 0], minlength=STATES * STATES)


def _rows(counts: np.ndarray) -> pa.RecordBatch:
    label, pair = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(label == 1, pa.bool_()), pa.array(pair, pa.int64()), pa.array(counts[label, pair], pa.int64())], ["secret", "pair", "n"])


PAIRS = "secret boolean, pair long, n long"


def _text_pairs(batches):
    counts = np.zeros((2, STATES * STATES), np.int64)
    for batch in batches:
        found = [x for t in batch.column("text").to_pylist() for x in labelled_runs(t or "")]
        for secret in (False, True):
            counts[int(secret)] += pair_counts([x for x, y in found if y == secret])
    yield _rows(counts)


def _run_pairs(batches):
    counts = np.zeros((2, STATES * STATES), np.int64)
    for batch in batches:
        found = list(zip(batch.column("run").to_pylist(), batch.column("secret").to_pylist(), strict=True))
        for secret in (False, True):
            counts[int(secret)] += pair_counts([x for x, y in found if y == secret])
    yield _rows(counts)


def weak_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """secret, pair, n: counts of the runs of about SAMPLE documents, a few rows a task.

    They are drawn by a hash of each row's id and place, so ids that repeat do not change their number. Null
    and empty texts give no runs, and an empty table no samples. A long text is one task's.
    """
    share = min(1.0, SAMPLE / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)))
    return chosen.select(F.col(text_col).alias("text")).mapInArrow(_text_pairs, PAIRS)


def drawn(alphabet: str, seed: int) -> list[str]:
    letters = np.random.default_rng(seed).choice(list(alphabet), (DRAWN, DRAWN_LENGTH))
    return ["".join(row) for row in letters.tolist()]


def train_markov(samples: DataFrame, alphabets: dict[str, str] | None = None) -> np.ndarray:
    """Log-likelihood ratios, each random model over the ordinary one: models x STATES x STATES.

    samples: (run, secret) rows, or their counts (secret, pair, n); the secret ones train the first model, drawn strings
    of each alphabet one more. A pair's count backs off to how frequent its second character is, with BACKOFF
    counts, and that to equal shares; so without samples and alphabets all ratios are 0 and
    nothing is found. Runs hold characters of ALPHABET only.
    """
    counted = samples.mapInArrow(_run_pairs, PAIRS) if "run" in samples.columns else samples
    counts = np.zeros((2, STATES * STATES))
    for r in counted.groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect():  # 2 * STATES ** 2 rows at most
        counts[int(r.secret), r.pair] += r.n
    counts = np.stack([*counts, *(pair_counts(drawn(letters, i)) for i, letters in enumerate((alphabets or {}).values()))]).reshape(-1, STATES, STATES)
    single = counts.sum(axis=1, keepdims=True) + 1
    p = np.log((counts + BACKOFF * single / single.sum(axis=2, keepdims=True)) / (counts.sum(axis=2, keepdims=True) + BACKOFF))
    return p[1:] - p[0]


class Scorer:
    """Whether runs are random, by the ratio of the models; frequent runs are looked up."""

    def __init__(self, ratio: np.ndarray):
        self.ratio, self.known = ratio.reshape(-1, STATES, STATES), {}

    def total(self, run: str) -> float:
        """The ratio of the whole run, the random models being equally likely."""
        codes = _codes(run)
        return float(np.logaddexp.reduce(self.ratio[:, codes[:-1], codes[1:]].sum(axis=1))) - math.log(len(self.ratio))

    def __call__(self, run: str) -> bool:
        found = self.known.get(run)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            total = self.total(run)
            found = self.known[run] = total >= TOTAL and total >= PER_CHARACTER * len(run)
        return found


def markov_spans(text: str, random: Scorer, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs, and of what base spans leave of them, those that are long enough and random."""
    covered = _covered(base)
    runs = (piece for m in RUN.finditer(text) for piece in _left(m.start(), m.end(), covered))
    return [(start, 3, end) for start, end in runs if end - start >= LEAST and random(text[start:end])]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(ratio: np.ndarray):
    def run(batches):
        random = Scorer(ratio)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                every = sorted(base + markov_spans(text or "", random, base))
                rows.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), len(every) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return run


def scan_secrets(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Offsets are code points, ends exclusive; kind:start:end by start, then kind.
    Null texts count as empty, repeated rows and null ids each have a row, an
    empty table gives an empty result, and other columns are ignored. Texts are
    scanned whole, however long.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(ratio), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(text: str, spans: str) -> str:
    """text with each span of the written form replaced by its kind."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join(out) + text[at:]


def op5_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train_markov(weak_samples(docs), ALPHABETS))
