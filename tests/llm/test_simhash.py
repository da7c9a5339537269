"""Fingerprints against a bit-by-bit count, links against all pairs, and the edge cases."""

import random

import pytest
import xxhash

from ledgerline.llm import simhash

from .conftest import CLASHES, EDGES


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, bits):
    """The smallest print that links of all pairs reach."""
    least = {p: p for p in prints}
    while True:
        new = {p: min(least[q] for q in prints if (p ^ q).bit_count() <= bits) for p in prints}
        if new == least:
            return least
        least = new


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    for text in [None, "", " \n", "one", "one Two", "One two THREE", "a b c d e f g a b c d", "Ünï ÇÖDÉ 漢字 \x1f x\x85y"]:
        assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)
    long = "word " * 70_000 + "end"
    assert simhash.fingerprint(long.encode()) == plain(long)


@pytest.mark.parametrize(("bits", "segments", "limit"), [(2, 2, 64), (2, 2, 3), (1, 2, 2), (3, 2, 2), (5, 3, 10**6)])
def test_links_are_those_of_all_pairs(spark, bits, segments, limit):
    draw = random.Random(bits)
    prints = {0, (1 << 64) - 1, 3, 1 << 63}
    for _ in range(6):  # families, dense in a few bits and chained over others
        centre = draw.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(6)) ^ (draw.getrandbits(2) << 40))
    prints |= {draw.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"), bits, segments, limit).collect()]
    assert all(a != b and (a ^ b).bit_count() <= bits for a, b in found) and len(set(map(frozenset, found))) == len(found)
    least, expected = {p: p for p in prints}, grouped(prints, bits)
    for _ in prints:
        for a, b in found:
            least[a] = least[b] = min(least[a], least[b])
        if least == expected:
            break
    assert least == expected


def test_half_of_a_ball_is_enough():
    assert len(simhash.ball(32, 1)) == 32 and len(simhash.ball(64, 2)) == 64 + 2016 and set(simhash.ball(64, 1)) == {signed(1 << i) for i in range(64)}


def test_documents(make):
    rows = [*EDGES, (20, "Same TEXT here for all"), (None, None)]
    found = simhash.similar_documents(make(rows, **CLASHES)).collect()
    assert len(found) == len(rows) and all(len(r.fingerprint) == 16 for r in found)
    expected = {t: f"{plain(t):016x}" for _, t in rows}
    by = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    assert by[(6, expected["same text here for all"])] == by[(20, expected["same text here for all"])] == 5
    assert by[(1, "0" * 16)] == by[(2, "0" * 16)] == by[(3, "0" * 16)] == by[(None, "0" * 16)] == 1
    assert by[(None, expected["no id at all here"])] is None
    groups = grouped({int(f, 16) for f in expected.values()}, 2)
    for r in found:
        alike = [i for i, t in rows if i is not None and groups[int(expected[t], 16)] == groups[int(r.fingerprint, 16)]]
        assert r.component_id == min(alike, default=None)


def test_no_documents(make):
    assert simhash.similar_documents(make([])).collect() == []


def test_near_copies_of_one_text(make):
    """A family of near copies, with small limits: cells are dense and chained."""
    words = [f"w{i}" for i in range(400)]
    draw = random.Random(3)
    texts = []
    for _ in range(60):
        own = list(words)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(400)] = f"x{draw.randrange(99)}"
        texts.append(" ".join(own))
    for limit in (2, 64):
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(make(texts), limit=limit).collect()}
        prints = [plain(t) for t in texts]
        groups = grouped(set(prints), 2)
        assert found == {i: min(j for j, q in enumerate(prints) if groups[q] == groups[p]) for i, p in enumerate(prints)}
    assert len(set(prints)) > 5 and len(set(groups.values())) < len(set(prints))
