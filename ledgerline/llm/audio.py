"""Audio columns: texts' bytes as 8-bit PCM, and log-mel features of what was stored.

A payload is written as a WAV file in a table's binary column, read back, and
turned into features in one pass without a shuffle: polyphase resampling by a
windowed sinc, overlapped frames, log-mel filterbanks, and segments by hysteresis
on frame energy. Features are stored in blocks of Arrow's stream format, whose tensor
column has Arrow's fixed-shape tensor type (POOLED x BANDS), beside the segments' time
spans, and are read back from there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import slices

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 16
FRAME, HOP, BANDS, POOLED = 256, 128, 16, 8
#: Segments open where a frame's energy is above the mean by OPEN deviations and close below CLOSE.
OPEN, CLOSE = 0.5, -0.25
MULTIPLE = 64
#: Samples that are resampled and framed at once.
CHUNK = 1 << 20


def payload(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(MULTIPLE, -(-len(text) // MULTIPLE) * MULTIPLE) - len(text))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; samples has an even length."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wav(wav: bytes) -> tuple[int, bytes]:
    """The rate and the samples of an 8-bit mono WAV file, walking its chunks."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(wav):
        name, size = struct.unpack_from("<4sI", wav, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """up x taps: the phases of a Hann-windowed sinc low-pass for resampling by up / down."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1].astype(np.float32))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Output k is phase (k * down) % up applied around input k * down // up."""
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    windows, h = np.lib.stride_tricks.sliding_window_view(padded, taps), phases(up, down, taps)
    out = np.empty(n, np.float32)
    for first in range(0, n, CHUNK):
        for phase in range(min(up, n - first)):
            k = np.arange(first + phase, min(n, first + CHUNK), up)  # these share one phase
            out[k] = windows[k * down // up] @ h[(int(k[0]) * down) % up]
    return out


@lru_cache
def mel_bank(rate: float, frame: int, bands: int) -> np.ndarray:
    """frame // 2 + 1 x bands triangles at equal steps of the mel scale."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """frames x BANDS log energies, and each frame's log energy; the last frame is padded."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    hann, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate, FRAME, BANDS)
    mel, energy = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    step = CHUNK // FRAME
    for at in range(0, frames, step):
        part = windows[at : at + step]
        mel[at : at + step] = np.log(np.abs(np.fft.rfft(part * hann, axis=1)).astype(np.float32) ** 2 @ bank + 1e-6)
        energy[at : at + step] = np.log((part * part).mean(axis=1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, open_: float = OPEN, close: float = CLOSE) -> list[tuple[int, int]]:
    """Frame spans that open above the upper level and close below the lower one."""
    mean, spread = float(energy.mean()), float(energy.std())
    found, start = [], None
    for i, e in enumerate(((energy - mean) / (spread + 1e-9)).tolist()):
        if start is None and e > open_:
            start = i
        elif start is not None and e < close:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(energy)))
    return found


def pool(mel: np.ndarray, rows: int = POOLED) -> np.ndarray:
    """Means of rows near-equal spans of frames; a span without a frame takes the nearest one."""
    edges = np.linspace(0, len(mel), rows + 1)
    return np.stack([mel[int(a) : max(int(a) + 1, int(b))].mean(axis=0) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _encode(batches):
    for batch in batches:
        for part in slices(batch):
            texts = [t or b"" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts_as_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes doc_id, n_bytes, media (a WAV file) as a table and returns what is read back.

    Null texts count as empty, and an empty text is 64 zero samples. Repeated
    rows and null ids each have a row; an empty table gives an empty result; other columns are ignored. A long
    text is one row, which a task holds with a few MB of others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stage(rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary"), "audio", path=path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, tensor array<float>, starts array<double>, ends array<double>"
BLOCKS = "first_id long, last_id long, n long, features binary"
#: The type that a document's features are stored as.
TENSOR = pa.fixed_shape_tensor(pa.float32(), (POOLED, BANDS), dim_names=("time", "mel"))
_NAMES = [c.split()[0] for c in FEATURES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), TENSOR, pa.list_(pa.float64()), pa.list_(pa.float64())]


def features(media: bytes) -> tuple:
    """All of FEATURES of a stored file but the first two; the tensor flat."""
    rate, samples = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x), rate * UP / DOWN)
    spans, seconds = segments(energy), HOP / (rate * UP / DOWN)
    return (
        len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-MULTIPLE:]), len(media), hashlib.sha256(media).hexdigest(), len(mel),
        pool(mel).astype(np.float32).ravel(), [s * seconds for s, _ in spans], [e * seconds for _, e in spans],
    )


def _feature_blocks(batches):
    for batch in batches:
        for part in slices(batch, "media", 256):
            columns = list(zip(*map(features, part.column("media").to_pylist()), strict=True))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(columns[6])), POOLED * BANDS)
            arrays = [part.column("doc_id"), part.column("n_bytes"), *(pa.ExtensionArray.from_storage(TENSOR, flat) if t is TENSOR else pa.array(c, t) for c, t in zip(columns, _TYPES[2:], strict=True))]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema(list(zip(_NAMES, _TYPES, strict=True)))) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays(arrays, _NAMES))
            ids = [i for i in part.column("doc_id").to_pylist() if i is not None]
            row = [[min(ids, default=None)], [max(ids, default=None)], [part.num_rows], [sink.getvalue().to_pybytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["first_id", "last_id", "n", "features"])


def store_features(media: DataFrame, path: str | None = None) -> DataFrame:
    """Writes BLOCKS of rows doc_id, n_bytes, media as a table and returns what is read back.

    Repeated rows and null ids each have their features; an empty table gives no blocks; other columns are ignored.
    """
    return stage(media.select("doc_id", "n_bytes", "media").mapInArrow(_feature_blocks, BLOCKS), "audio-features", path=path)


def tensors(block: bytes) -> pa.Table:
    """A block's rows as Arrow reads them: its tensor column has the type TENSOR."""
    return pa.ipc.open_stream(block).read_all()


def _read_features(batches):
    for batch in batches:
        for block in batch.column("features").to_pylist():
            for part in tensors(block).to_batches():
                yield pa.RecordBatch.from_arrays([c.storage.cast(pa.list_(pa.float32())) if isinstance(c, pa.FixedShapeTensorArray) else c for c in part.columns], _NAMES)


def read_features(blocks: DataFrame) -> DataFrame:
    """FEATURES of stored blocks, one row for each document."""
    return blocks.select("features").mapInArrow(_read_features, FEATURES)


def audio_features(media: DataFrame) -> DataFrame:
    """FEATURES of rows doc_id, n_bytes, media, by way of the stored tensors."""
    return read_features(store_features(media))


def op8_audio(spark, sf_dir):
    found = audio_features(store_texts_as_audio(table(spark, sf_dir, "documents")))
    written = F.array_join(F.transform("tensor", lambda x: F.format_number(x, 2)), " ")
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws("-", F.format_number(a, 3), F.format_number(b, 3))), " ")
    return found.withColumn("feature", F.concat_ws("|", F.col("frames"), F.md5(written), F.size("starts"), F.md5(spans))).drop("tensor", "starts", "ends")
