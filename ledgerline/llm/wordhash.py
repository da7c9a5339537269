"""64-bit hashes of words and of word sequences, for shingles and n-grams."""

from __future__ import annotations

import numpy as np

#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Known()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def sequence_hashes(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash for each position i of the words at i + offset, in that order."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for o in offsets:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[o : o + n] + np.uint64(len(offsets)))
    return out
