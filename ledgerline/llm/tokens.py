"""Token ids of whole texts with a public tokenizer file, inside Spark tasks."""

from __future__ import annotations

import json
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a generation of a worker's memory holds: some 100 MB in both.
REMEMBERED = 400_000
#: The text rules under which a text's ids are those of its words in turn.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
#: Marks that, after an ASCII letter, are a token run of their own.
TRAILING = string.punctuation.encode()
#: Texts with these are not case-folded beforehand: special tokens are matched as they stand, and a
#: combining mark (U+0300 to U+037F) may join a small letter but not its capital.
UNFOLDED = (b"<|", b"\xcc", b"\xcd")


def tokenizer_path(name: str) -> str:
    """A path as it is, or the name of a file among the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Values of keys in two generations: a full one becomes the old one, whose keys move over when met again."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.size:
            self.now, self.old = {}, self.now

    def missing(self, keys: set) -> list:
        """The keys without a value; those of the old generation are moved."""
        now, old, unknown = self.now, self.old, []
        for k in keys.difference(now):
            if k in old:
                now[k] = old[k]
            else:
                unknown.append(k)
        return unknown


class TextEncoder:
    """Serialized ids (little-endian, dtype) of UTF-8 texts.

    Under the rules NORMALIZER and PRE_TOKENIZER no token reaches over white space,
    so a text's ids are those of its words in turn, and words met before need not
    be encoded again. A batch is split and its distinct words found by Arrow;
    only those are looked up. A word that ends in an ASCII letter and marks is its
    stem, folded if ASCII, and its marks: nothing composes with an ASCII letter
    that marks follow, so it is still a letter after normalization and ends a run.
    Under any other rules whole texts are encoded.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.dtype = "<u2" if t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        rules = [json.loads(x.__getstate__()) if x else None for x in (t.normalizer, t.pre_tokenizer)]
        added = t.get_added_tokens_decoder()
        self.by_word = rules == [NORMALIZER, PRE_TOKENIZER] and bool(added) and t.post_processor is None and all(
            a.content.startswith("<|") and a.content.islower() and not any(c.isspace() for c in a.content) and not (a.normalized or a.lstrip or a.rstrip or a.single_word) for a in added.values()
        )
        if not self.by_word:
            return
        self.between, content = max((i, a.content) for i, a in added.items())
        self.join = f" {content} "
        #: The same model for words of small ASCII letters, and for words already normalized.
        self.letters, self.normalized = Tokenizer(t.model), Tokenizer(t.model)
        self.letters.pre_tokenizer, self.normalized.pre_tokenizer = pre_tokenizers.WhitespaceSplit(), t.pre_tokenizer
        for small in (self.letters, self.normalized):
            small.add_special_tokens([AddedToken(content, special=True, normalized=False)])
        self.between_here = self.normalized.token_to_id(content)
        self.words = Memory(REMEMBERED)
        self.words.now[b""] = b""

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _at_once(self, tokenizer, text: str) -> list[bytes]:
        """Ids of what stands between the separators of text."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.between_here).tolist()
        raw, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        return [raw[width * (a + 1) : width * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]

    def _split(self, word: bytes) -> tuple[bytes, bytes]:
        """A stem and marks whose ids in turn are the word's."""
        if word.isalpha():  # bytes: ASCII letters
            return word.lower(), b""
        stem = word if b"<|" in word else word.rstrip(TRAILING)
        if not stem[-1:].isalpha():
            stem = word
        return stem.lower() if stem.isascii() and b"<|" not in stem else stem, word[len(stem) :]

    def _learn(self, new: list[bytes]) -> None:
        """Remembers the ids of new words, by way of their stems and marks."""
        split, now = {w: self._split(w) for w in new}, self.words.now
        missing = self.words.missing({x for pair in split.values() for x in pair})
        letters, special, other = [], [], []
        for x in missing:
            (letters if x.isalpha() else special if b"<|" in x else other).append(x)
        if letters:
            now.update(zip(letters, self._at_once(self.letters, self.join.join(x.decode() for x in letters)), strict=True))
        if other:
            text = self.tokenizer.normalizer.normalize_str(self.join.join(x.decode("utf-8", "replace") for x in other))
            now.update(zip(other, self._at_once(self.normalized, text), strict=True))
        if special:
            now.update(zip(special, self._ids([x.decode("utf-8", "replace") for x in special]), strict=True))
        now.update((w, now[s] + now[m]) for w, (s, m) in split.items())

    @staticmethod
    def _folded(texts: pa.Array) -> pa.Array:
        """Texts with ASCII letters folded and a comma or stop after one set apart; their ids are the same."""
        folded = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([,.])\s", r"\1 \2 ")
        kept = [any(x in t for x in UNFOLDED) for t in texts.cast(pa.binary()).to_pylist()]
        return pc.if_else(pa.array(kept), texts, folded) if any(kept) else folded

    def encode(self, texts: pa.Array) -> list[bytes]:
        """One value for each text of a string or binary array; null counts as the empty text."""
        if not self.by_word:
            return self._ids([(t or b"").decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()])
        texts = pc.fill_null(pc.cast(texts, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)), "")
        self.words.turn()
        parts = pc.ascii_split_whitespace(self._folded(texts))
        found = parts.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary()).to_pylist()
        new = self.words.missing({b"", *words})
        if new:
            self._learn(new)
        ids = pa.array(map(self.words.now.__getitem__, words), pa.large_binary(), size=len(words)).take(found.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, np.int64)[np.asarray(parts.offsets)].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 2_048, size: int = 4 << 20):
    """Parts of a batch of at most so many rows and, but for single longer texts, bytes of a column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for at, n in enumerate(lengths):
        if at > first and (at - first == rows or held + n > size):
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


_encoders: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """One encoder for each tokenizer file and worker process."""
    if name not in _encoders:
        _encoders[name] = TextEncoder(name)
    return _encoders[name]
