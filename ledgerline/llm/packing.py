"""Packs documents into training sequences, balanced by attention cost.

Tasks encode whole texts; a document's full-length pieces are sequences of their
own, and only its shorter rest is dealt by a hash of the id. Inside a task, rests
are packed in bounded blocks: longest first, each goes to the sequence of lowest
estimated cost (linear plus quadratic in the piece's length, since attention
stays inside a document) among those with room. What fits nowhere whole is cut
into the largest gaps, so a block leaves less than one sequence of padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder, slices

LENGTH = 2_048
#: Rests that are packed together: some 20 MB in a task at most.
BLOCK = 4_096
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1 / 2_048
PIECES = "doc_id long, salt long, start long, length long, doc_tokens long, ids binary, ids_crc32 long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECES = pa.schema([*((c, pa.int64()) for c in ("doc_id", "salt", "start", "length", "doc_tokens")), ("ids", pa.binary()), ("ids_crc32", pa.int64())])
_PACKED = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _crc(ids: bytes, dtype: str) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())


def _cut(tokenizer: str, end: int, length: int, keep_ids: bool):
    """Documents -> full pieces, which are complete, and rests."""

    def run(batches):
        coder = encoder(tokenizer)
        width = np.dtype(coder.dtype).itemsize
        tail = np.array([end], coder.dtype).tobytes()
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, salt, ids in zip(part.column("doc_id").to_pylist(), part.column("salt").to_pylist(), coder.encode(part.column("text")), strict=True):
                    ids += tail
                    total = len(ids) // width
                    for start in range(0, total, length):
                        piece = ids[start * width : (start + length) * width]
                        n = len(piece) // width
                        full = n == length
                        out.append((doc, salt, start, n, total, None if full and not keep_ids else piece, _crc(piece, coder.dtype) if full else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return run


def assign(lengths: list[int], capacity: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """For each item the (sequence, first, length) parts it is placed in; most items have one."""
    sequences = max(1, -(-sum(lengths) // capacity))
    room, cost = np.full(sequences, capacity), np.zeros(sequences)
    placed: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        first, left = 0, lengths[k]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            to = int(fits.argmin())
            if fits[to] == np.inf:
                to = int(room.argmax())
            n = min(left, int(room[to]))
            placed[k].append((to, first, n))
            room[to] -= n
            cost[to] += linear * n + quadratic * n * n
            first, left = first + n, left - n
    return placed


def _pack(dtype: str, length: int, keep_ids: bool, linear: float, quadratic: float):
    def run(batches):
        from pyspark import TaskContext

        width = np.dtype(dtype).itemsize
        base = TaskContext.get().partitionId() << 36
        used, rests = 0, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

        def flush():
            nonlocal used, rests
            fill: dict[int, int] = {}
            rows = []
            for (doc, start, _, total, ids), parts in zip(rests, assign([r[2] for r in rests], length, linear, quadratic), strict=True):
                for to, first, n in parts:
                    piece = ids[first * width : (first + n) * width]
                    rows.append((doc, start + first, n, _crc(piece, dtype), total, base + used + to, fill.get(to, 0), piece if keep_ids else None))
                    fill[to] = fill.get(to, 0) + n
            used, rests = used + len(fill), []
            return out(rows)

        for batch in batches:
            full = []
            for doc, start, n, total, ids, crc in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32")), strict=True):
                if n == length:
                    full.append((doc, start, n, crc, total, base + used, 0, ids))
                    used += 1
                    continue
                rests.append((doc, start, n, total, ids))
                if len(rests) == BLOCK:
                    yield flush()
            if full:
                yield out(full)
        if rests:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, keep_ids: bool = True, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: PACKED.

    A null or empty text is a document of the end id alone. Rows that repeat an
    id are packed as documents of their own, and null ids stay null. An empty
    table gives an empty result. Other columns of docs are ignored. A long text
    is cut in one task, which holds its ids; its full pieces then go separate
    ways. Rows are dealt by a hash of id and text, so that a result depends on
    the rows and the number of shuffle partitions alone.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(id_col, text_col).alias("salt"),
        F.col(text_col).cast("binary").alias("text"),
    )
    pieces = rows.mapInArrow(_cut(tokenizer, end, length, keep_ids), PIECES)
    dealt = pieces.repartition("salt").sortWithinPartitions("salt", "start")
    return dealt.mapInArrow(_pack(encoder(tokenizer).dtype, length, keep_ids, linear, quadratic), PACKED)


def op6_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end=1, keep_ids=False).drop("ids")
