"""Alignment of two tokenizers' tokens, and how often each pair of ids is linked over all documents.

1. Each task takes its Arrow batches in blocks of bounded bytes. A text is cut at single spaces between two other characters:
   the tokens of either tokenizer end there (no piece of the second holds a space mark behind another character, which
   is checked), so that the tokens of a text are those of its words, and words met before need not be aligned again.
2. New words lie behind each other on one axis of bytes, and DuckDB aligns their token intervals: a window over the ends that both
   tokenizers share numbers the groups, an ASOF join finds the group of each token of the first, a range join that of
   each token of the second, and tokens of a group are linked.
3. DuckDB also counts in how many of a block's documents each pair of ids is linked. Spark merges these partial counts, of which there is
   one a block and pair, and gives each block the counts of its own pairs back.
4. A block's documents add up their words' sums.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import Memory, slices, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words whose alignment a worker remembers (a generation of its memory), and their characters at most.
REMEMBERED, SHORT = 130_000, 64
#: Bytes of new words that are aligned at a time, but for single longer ones.
AT_ONCE = 1 << 18
#: Rows and bytes of a block.
ROWS, SIZE = 4_096, 2 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
#: In a text without this, every space is such a one; the characters that \s means in CUT, for Arrow's regular expressions.
WHITE = r"[\t-\r\x1c-\x20\x{85}\pZ]"
UNEVEN = f"{WHITE}{WHITE}|^ | $"
SPACE = "▁"

#: Rows of a block: its documents (k: place), its pairs of ids (k: number; docs: documents of the block that hold it linked), and one with all else.
BLOCKS = "block long, k int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs long, rest binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

# Tables a, b: w (word), id, s, e (bytes of the axis).
SPANS = """
SELECT lag(e, 1, 0) OVER (ORDER BY e) AS s, e, CAST(sum(1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g
FROM (SELECT e FROM a SEMI JOIN b USING (e))
"""
GROUPED_A = "SELECT a.w, a.s, a.id, spans.g FROM a ASOF JOIN spans ON a.e <= spans.e"
# Most tokens of b are a group's only one there and equal it; what is left lies within the groups that are left.
GROUPED_B = """
SELECT b.w, b.s, b.id, spans.g FROM b JOIN spans USING (s, e) UNION ALL
SELECT x.w, x.s, x.id, y.g FROM (SELECT * FROM b ANTI JOIN spans USING (s, e)) x JOIN (SELECT * FROM spans ANTI JOIN b USING (s, e)) y ON x.s >= y.s AND x.e <= y.e
"""
SIZES = """
WITH x AS (SELECT g, any_value(w) AS w, count(*) AS n_a FROM ga GROUP BY g), y AS (SELECT g, count(*) AS n_b FROM gb GROUP BY g)
SELECT g, w, n_a, n_b, n_a * n_b AS n_links FROM x JOIN y USING (g)
"""
SUMMED = "SELECT w, CAST(sum(n_a) AS BIGINT) AS n_a, CAST(sum(n_b) AS BIGINT) AS n_b, count(*) AS n_groups, CAST(sum(n_links) AS BIGINT) AS n_links, max(n_links) AS most FROM sizes GROUP BY w ORDER BY w"
#: Tokens in the order in which a document's groups are written.
WRITTEN = """
SELECT w, g, side, id FROM (SELECT w, g, 0 AS side, s, id FROM ga UNION ALL SELECT w, g, 1, s, id FROM gb) ORDER BY g, side, s
"""
LINKED = """
SELECT ga.w, (CAST(ga.id AS BIGINT) << 32) + gb.id AS pair, count(*) AS links FROM ga JOIN gb USING (g) GROUP BY ALL ORDER BY ga.w, pair
"""
#: Links of a group above which its tokens are first counted by id, so that repetitive texts without shared ends don't make their links one by one.
DENSE = 4_096
LINKED_DENSE = """
WITH x AS (SELECT g, w, id, count(*) AS n FROM ga GROUP BY ALL), y AS (SELECT g, id, count(*) AS n FROM gb GROUP BY ALL)
SELECT x.w, (CAST(x.id AS BIGINT) << 32) + y.id AS pair, CAST(sum(x.n * y.n) AS BIGINT) AS links FROM x JOIN y USING (g) GROUP BY ALL ORDER BY x.w, pair
"""
# Tables held: d, w (the distinct words of each document); linked: w, k (number of a pair).
COUNTED = "SELECT k, count(*) AS docs FROM (SELECT DISTINCT d, k FROM held JOIN linked USING (w)) GROUP BY k ORDER BY k"


def byte_level() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


SPACED = "\u0120"  # a space, as byte-level vocabularies write it
#: A word of letters of one or two bytes which every release of Unicode calls letters, perhaps with ASCII marks behind, and how byte-level vocabularies write the letters.
SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)").fullmatch
LETTERS = {c: "".join({b: x for x, b in byte_level().items()}[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}


class Aligner:
    """Alignments of words by two tokenizer files: a byte-level one and one of pieces."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import duckdb
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.b = Tokenizer.from_file(tokenizer_path(a)), SentencePieceProcessor(model_file=tokenizer_path(b))
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        of, special = byte_level(), self.a.get_added_tokens_decoder()
        self.letters = Tokenizer(self.a.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.a_bytes = [bytes(of[c] for c in self.a.id_to_token(i)) if i not in special else b"" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_starts = np.array([x.startswith(b" ") for x in self.a_bytes])
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.marks = lru_cache(10_000)(lambda marks: self.a.encode(marks, add_special_tokens=False).ids)
        self.written = {m: [f"{m}{i}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for m in ";|,"}
        self.words = Memory(REMEMBERED)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text; of a null or empty one none."""
        texts = texts.take(pa.array(np.arange(len(texts))))  # compact: if_else misreads what is a slice of another array
        texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts)
        if not self.by_word:
            return pa.array([[] if t is None else [t] for t in texts.to_pylist()], pa.list_(pa.string()))
        uneven = pc.fill_null(pc.match_substring_regex(texts, UNEVEN), False)
        even = pc.fill_null(pc.split_pattern(pc.if_else(uneven, pa.scalar(None, pa.string()), texts), " "), pa.scalar([], pa.list_(pa.string())))
        at = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if not len(at):
            return even
        order = np.arange(len(texts))
        order[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([even, pa.array([CUT.split(t) for t in texts.take(pa.array(at)).to_pylist()], pa.list_(pa.string()))]).take(pa.array(order))

    def align(self, words: list[str]) -> dict[str, tuple | None]:
        """For each word, with a space before it: its sums (n_a, n_b, n_groups, n_links), groups, and pairs with their links, as bytes; None if its tokens do not spell it."""
        found: dict[str, tuple | None] = {}
        first = size = 0
        for k, w in enumerate(words):
            if k > first and size + len(w) > AT_ONCE:
                found |= self._some(words[first:k])
                first, size = k, 0
            size += len(w)
        return found | self._some(words[first:])

    def _first_ids(self, words: list[str]) -> list[list[int]]:
        """Ids by the first tokenizer of a space and each word.

        A word of letters is one run for it, and so are marks behind it, so such words need no splitting; a token that starts with the space starts a word.
        """
        parts = [SIMPLE(w) for w in words]
        simple = [k for k, m in enumerate(parts) if m]
        ids: list[list[int]] = [[]] * len(words)
        if simple:
            flat = np.array(self.letters.encode_batch_fast(["\n".join([SPACED + parts[k][1].translate(LETTERS) for k in simple])], add_special_tokens=False)[0].ids)
            starts = np.flatnonzero(self.a_starts[flat]).tolist()
            flat = flat.tolist()
            for k, p, q in zip(simple, starts, [*starts[1:], len(flat)], strict=True):
                ids[k] = flat[p:q] + self.marks(parts[k][2]) if parts[k][2] else flat[p:q]
        other = [k for k, m in enumerate(parts) if not m]
        for k, e in zip(other, self.a.encode_batch_fast([" " + words[k] for k in other], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        return ids

    def _spell(self, raws: list[bytes], *sides: list[list[int]]) -> bool:
        """Whether the tokens of both sides spell every word."""
        for ids, of, sizes in zip(sides, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes), strict=True):
            flat = list(chain.from_iterable(ids))
            ends = np.cumsum([len(x) for x in ids])
            total = np.concatenate(([0], np.cumsum(sizes[np.array(flat, np.int64)])))[np.concatenate(([0], ends))]
            if np.diff(total).tolist() != [len(r) for r in raws] or b"".join([of[i] for i in flat]) != b"".join(raws):
                return False
        return True

    def _some(self, words: list[str]) -> dict[str, tuple | None]:
        found: dict[str, tuple | None] = dict.fromkeys(words)
        ids_a, ids_b = self._first_ids(words), self.b.encode(words, num_threads=1)
        raws = [b" " + w.encode() for w in words]
        spelled = range(len(words))
        if not self._spell(raws, ids_a, ids_b):  # all at once; word by word only if some word fails
            spelled = [k for k in spelled if self._spell(raws[k : k + 1], ids_a[k : k + 1], ids_b[k : k + 1])]
        if not spelled:
            return found
        db = self.db
        for name, ids, of in (("a", ids_a, self.a_sizes), ("b", ids_b, self.b_sizes)):
            flat = np.fromiter(chain.from_iterable(ids[k] for k in spelled), np.int32)
            ends = np.cumsum(of[flat])
            db.register(name, pa.table({"w": np.repeat(np.array(spelled, np.int32), [len(ids[k]) for k in spelled]), "id": flat, "s": ends - of[flat], "e": ends}))
        db.execute(f"CREATE OR REPLACE TEMP TABLE spans AS {SPANS}")
        db.execute(f"CREATE OR REPLACE TEMP TABLE ga AS {GROUPED_A}")
        db.execute(f"CREATE OR REPLACE TEMP TABLE gb AS {GROUPED_B}")
        db.execute(f"CREATE OR REPLACE TEMP TABLE sizes AS {SIZES}")
        numbers, written = db.execute(SUMMED).fetchnumpy(), db.execute(WRITTEN).fetchnumpy()
        linked = db.execute(LINKED if numbers["most"].max() <= DENSE else LINKED_DENSE).fetchnumpy()
        texts = self._groups_texts(*(written[c] for c in ("w", "g", "side", "id")))
        at = (16 * np.searchsorted(linked["w"], [*spelled, len(words)])).tolist()
        pairs = np.stack([linked["pair"], linked["links"]], axis=1).tobytes()
        sums = np.stack([numbers[c] for c in ("n_a", "n_b", "n_groups", "n_links")], axis=1).tobytes()
        for i, (w, text, p, q) in enumerate(zip(numbers["w"].tolist(), texts, at[:-1], at[1:], strict=True)):
            found[words[w]] = (sums[32 * i : 32 * i + 32], text, pairs[p:q])
        for name in ("spans", "ga", "gb", "sizes"):
            db.execute(f"DROP TABLE {name}")
        return found

    def _groups_texts(self, w: np.ndarray, g: np.ndarray, side: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """a1,a2|b1;a3|b2 for each word, of tokens in this order."""
        new = np.flatnonzero(np.diff(w, prepend=-1)).tolist()
        marks = np.where(np.diff(g, prepend=-1) != 0, 0, np.where(np.diff(side, prepend=0) != 0, 1, 2)).tolist()
        written = [self.written[m] for m in ";|,"]
        parts = [written[m][i] for m, i in zip(marks, ids.tolist(), strict=True)]
        return ["".join(parts[p:q])[1:].encode() for p, q in zip(new, [*new[1:], len(parts)], strict=True)]

    def known(self, words: list[str]) -> list[tuple | None]:
        """Alignments of distinct words; short ones are remembered."""
        long = {w for w in words if len(w) > SHORT}
        new = self.words.missing(set(words) - long)
        if new:
            self.words.now.update(self.align(new))
        if not long:
            return list(map(self.words.now.__getitem__, words))
        held = self.align(list(long))
        return [held[w] if w in long else self.words.now[w] for w in words]

    def block(self, texts: pa.Array) -> tuple[list, list[np.ndarray], bytes]:
        """For texts the columns n_a, n_b, n_groups, n_links, groups_sha256; for the block's pairs their codes and documents; and the rest, packed."""
        self.words.turn()
        cut = self.cut(texts)
        while True:
            coded = cut.flatten().dictionary_encode()
            words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            cuts = np.asarray(cut.offsets).astype(np.int64)
            cuts -= cuts[0]
            found = self.known(words)
            bad = np.array([x is None for x in found], bool)[at] if None in found else np.zeros(len(at), bool)
            # A word that its tokens do not spell may still be part of a text that they do: those texts are taken in whole.
            broken = set((np.searchsorted(cuts, np.flatnonzero(bad), "right") - 1).tolist())
            if not broken:
                break
            lists = cut.to_pylist()
            cut = pa.array([([texts[k].as_py()] if len(x) > 1 else []) if k in broken else x for k, x in enumerate(lists)], pa.list_(pa.string()))
        sums = np.frombuffer(b"".join([x[0] for x in found]), np.int64).reshape(-1, 4)
        groups = [x[1] for x in found]
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(sums[at], axis=0)))
        columns = list((total[cuts[1:]] - total[cuts[:-1]]).T)
        shas, own, times = [], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            shas.append(hashlib.sha256(b";".join([groups[i] for i in at[p:q].tolist()])).hexdigest() if q > p else "")
            some, often = np.unique(at[p:q], return_counts=True)
            own.append(some)
            times.append(often)
        n_words, n_pairs = [len(x) for x in own[1:]], [len(x[2]) // 16 for x in found]
        own, times = np.concatenate(own), np.concatenate(times)
        pairs, links = np.frombuffer(b"".join([x[2] for x in found]), np.int64).reshape(-1, 2).T
        codes, of = np.unique(pairs, return_inverse=True)
        self.db.register("held", pa.table({"d": np.repeat(np.arange(len(texts), dtype=np.int32), n_words), "w": own}))
        self.db.register("linked", pa.table({"w": np.repeat(np.arange(len(found), dtype=np.int32), n_pairs), "k": of.astype(np.int32)}))
        docs = self.db.execute(COUNTED).fetchnumpy()["docs"]
        return [*columns, shas], [codes, docs], packed(n_words, own, times, n_pairs, of, links)


def packed(*arrays) -> bytes:
    """Arrays of whole numbers in one compressed value."""
    import zstandard

    wide = [np.asarray(x, np.int64) for x in arrays]
    raw = [x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.int64) for x in wide]
    head = np.array([v for x in raw for v in (len(x), x.itemsize)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(x.tobytes() for x in raw))


def unpacked(value: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    head, at, out = np.frombuffer(raw, np.int64, 2 * n).reshape(-1, 2).tolist(), 16 * n, []
    for length, width in head:
        out.append(np.frombuffer(raw, np.uint32 if width == 4 else np.int64, length, at).astype(np.int64))
        at += length * width
    return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str = A, b: str = B) -> Aligner:
    """One for each pair of tokenizer files and worker process."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _batch(n: int, **columns) -> pa.RecordBatch:
    """n rows of BLOCKS; columns that are not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split() for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[kind]) if c in columns else pa.nulls(n, kinds[kind]) for c, kind in names], [c for c, _ in names])


def utf8(values: pa.Array) -> pa.Array:
    """Binary values as strings; what isn't UTF-8 in them becomes U+FFFD."""
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v and v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())


def _blocks(a: str, b: str):
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, rows=ROWS, size=SIZE):
                texts = utf8(part.column("text"))
                columns, (codes, docs), rest = aligner(a, b).block(texts)
                n, m = len(texts), len(codes)
                named = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True))
                yield _batch(n, block=np.full(n, block), k=np.arange(n), doc_id=part.column("doc_id"), **named)
                yield _batch(m, block=np.full(m, block), k=np.arange(m), a=codes >> 32, b=codes & 0xFFFFFFFF, docs=docs)
                yield _batch(1, block=[block], rest=[rest])
                block += 1
                pa.default_memory_pool().release_unused()

    return run


def _sums(own: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents and rest, and its pairs with their counts over all documents -> RESULT."""
    (rest,) = [r for r in own.column("rest").to_pylist() if r is not None]
    docs = own.filter(pc.is_valid(own.column("k"))).sort_by("k")
    n_words, words, times, n_pairs, of, links = unpacked(rest, 6)
    cuts = np.concatenate(([0], np.cumsum(n_words)))
    word = np.repeat(np.arange(len(n_pairs)), n_pairs)
    at, out = pairs.column("number").to_numpy(), {}
    for name in ("best", "count"):
        value = np.zeros(len(at), np.int64)
        value[at] = pairs.column(name).cast(pa.int64()).to_numpy()
        each = np.zeros(len(n_pairs), np.int64)
        np.add.at(each, word, links * value[of])
        total = np.concatenate(([0], np.cumsum(each[words] * times)))
        out[name] = total[cuts[1:]] - total[cuts[:-1]]
    found = {"n_best": out["best"], "count_sum": out["count"]}
    return pa.table({c: found[c] if c in found else docs.column(c) for c in (x.split()[0] for x in RESULT.split(", "))})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count, best: in how many documents each pair of ids is linked, and whether none of its first id's pairs is in more."""
    counts = stage(blocks.filter("a is not null").groupBy("a", "b").agg(F.sum("docs").alias("count")), "align-counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row for each id of the first vocabulary at most
    return counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, a: str = A, b: str = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: a byte-level tokenizer file, applied to a space and the text; b: a piece model, which adds that space itself. Bytes at which
    tokens of both end cut them into groups, and all pairs of tokens of a group are linked. n_best: links of a pair of ids that
    is linked in no fewer documents than any other pair of its first id; count_sum: over all links, in how many documents their pair
    is linked. Null and empty texts, and those that the tokens do not spell, have no tokens: zeros and an
    empty groups_sha256. Rows that repeat an id or a text each have a row and count as documents of their own; null ids stay. A very
    long text is a block of its own. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    blocks = stage(rows.mapInArrow(_blocks(a, b), BLOCKS), "align-blocks")
    counts = pair_counts(blocks)
    pairs = blocks.filter("a is not null").select(F.col("block").alias("of"), F.col("k").alias("number"), "a", "b")
    valued = pairs.join(counts, ["a", "b"]).select("of", "number", "count", "best")
    documents = blocks.filter("a is null").drop("a", "b", "docs")
    return documents.groupBy("block").cogroup(valued.groupBy("of")).applyInArrow(_sums, RESULT)


def op13_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"))
