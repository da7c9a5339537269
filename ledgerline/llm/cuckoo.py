"""A cuckoo filter over digests, and one bucket's live digests."""

from __future__ import annotations

from array import array

SLOTS = 4
KICKS = 200
#: Contents are kept by these bits of their digest's home.
HOMES = (1 << 14) - 1


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket; supports deletion.

    A digest's fingerprint is its first two bytes (0 stands for an empty slot
    and becomes 1); its home bucket comes from the next eight bytes and its
    other bucket from that one and the fingerprint alone.
    """

    def __init__(self, buckets: int = 64, table: bytes | None = None):
        self.table = array("H", table if table is not None else bytes(2 * SLOTS * buckets))
        self.mask = len(self.table) // SLOTS - 1
        self._turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        home = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, home, self._other(home, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _bucket(self, b: int) -> array:
        return self.table[SLOTS * b : SLOTS * b + SLOTS]

    def __contains__(self, digest: bytes) -> bool:
        tag, a, b = self._places(digest)
        return tag in self._bucket(a) or tag in self._bucket(b)

    def _put(self, b: int, tag: int) -> bool:
        for i in range(SLOTS * b, SLOTS * b + SLOTS):
            if not self.table[i]:
                self.table[i] = tag
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False on overflow: the filter must then be rebuilt larger, as one tag is homeless."""
        tag, a, b = self._places(digest)
        if self._put(a, tag) or self._put(b, tag):
            return True
        at = b
        for _ in range(KICKS):
            self._turn += 1
            i = SLOTS * at + self._turn % SLOTS
            tag, self.table[i] = self.table[i], tag
            at = self._other(at, tag)
            if self._put(at, tag):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests known to be present."""
        tag, a, b = self._places(digest)
        for at in (a, b):
            for i in range(SLOTS * at, SLOTS * at + SLOTS):
                if self.table[i] == tag:
                    self.table[i] = 0
                    return True
        return False


class LiveDigests:
    """One bucket of the index: its filter, and the live contents that hits are verified against.

    Contents are kept by the filter bucket that their digest calls home: a miss of the filter looks at none of
    them, a hit at the few of one bucket. What is verified is the whole digest, with the text's length and
    another hash of it; contents that differ in any of these are different ones.
    """

    def __init__(self, table: bytes | None = None):
        self.filter = CuckooFilter(table=table)
        self.contents: dict[int, dict[bytes, list]] = {}
        self.size = self.hits = self.false_hits = self.resizes = 0

    def _home(self, content: bytes) -> dict[bytes, list]:
        return self.contents.setdefault(int.from_bytes(content[2:10], "little") & HOMES, {})

    def __iter__(self):
        """(content, smallest id, number of copies)."""
        for home in self.contents.values():
            for content, (doc_id, n) in home.items():
                yield content, doc_id, n

    def load(self, content: bytes, doc_id, n: int) -> None:
        """A stored content, which the filter knows."""
        self._home(content)[content] = [doc_id, n]
        self.size += 1

    def _grow(self) -> None:
        buckets = 2 * (self.filter.mask + 1)
        while True:
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(c) for c, _, _ in self):
                break
            buckets *= 2
        self.resizes += 1

    def insert(self, content: bytes, doc_id, n: int) -> bool:
        """True if the content was not live. A live one gains n copies and the smaller id."""
        if content in self.filter:  # a miss needs no look at what is stored
            self.hits += 1
            stored = self._home(content).get(content)
            if stored is not None:
                if doc_id is not None and (stored[0] is None or doc_id < stored[0]):
                    stored[0] = doc_id
                stored[1] += n
                return False
            self.false_hits += 1
        self._home(content)[content] = [doc_id, n]
        self.size += 1
        if not self.filter.insert(content):
            self._grow()
        return True

    def delete(self, content: bytes) -> bool:
        if content in self.filter and self._home(content).pop(content, None) is not None:
            self.size -= 1
            return self.filter.delete(content)
        return False
