"""Closure, mentions, edits and interval joins on small and adverse inputs."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import closure, edits, intervals, mentions, textindex


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(closure, "ROUNDS", 20)
    ids = list(range(10_000))
    random.Random(1).shuffle(ids)
    found = {r.id: r.component for r in closure.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert len(found) == 10_000 and set(found.values()) == {0}


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(160)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7000, 7000), (None, 3), (4, None)]
    found = {r.id: r.component for r in closure.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {v: v for p in pairs if None not in p and p[0] != p[1] for v in p}
    for _ in least:
        for a, b in pairs:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
    assert closure.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merges(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (8, 9)], "a long, b long")
    standing = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id long, standing int")
    canonical = closure.canonical_ids(pairs, standing=standing)
    assert {(r.id, r.canonical_id, r.n) for r in canonical.collect()} == {(1, 3, 3), (2, 3, 3), (3, 3, 3), (8, 8, 2), (9, 8, 2)}
    roles = spark.createDataFrame([(1, "lp", 0, 0.9), (3, "lp", 1, 0.2), (2, "gp", 0, 0.5), (7, "gp", 0, 0.1)], "entity_id long, role string, is_primary int, confidence double")
    assert {tuple(r) for r in closure.unite_roles(roles, canonical).collect()} == {(3, "lp", 1, 0.9), (3, "gp", 0, 0.5), (7, "gp", 0, 0.1)}
    facts = spark.createDataFrame([(1, 1, "p", None, 1), (2, 3, "p", None, 1), (3, 2, "p", "s", 1), (4, 1, "p", "s", 1), (5, 2, "p", None, 0)], "fact_id long, entity_id long, predicate string, source string, is_current int")
    assert {(r.fact_id, r.entity_id, r.is_current) for r in closure.move_facts(facts, canonical, ["predicate", "source"], "fact_id").collect()} == {(1, 3, 0), (2, 3, 1), (3, 3, 1), (4, 3, 0), (5, 3, 0)}
    edges = spark.createDataFrame([(1, 1, 7, "k"), (2, 3, 7, "k"), (3, 2, 7, "j"), (4, 1, 2, "k"), (5, 7, 9, "k"), (6, 7, 8, "k")], "edge_id long, src long, dst long, kind string")
    assert {tuple(r) for r in closure.move_edges(edges, canonical, ["kind"], "edge_id").collect()} == {(2, 3, 7, "k"), (3, 3, 7, "j"), (6, 7, 8, "k")}


def test_mentions(spark):
    texts = {1: "Acme acme ACME corp and Acme Corp", 2: "aaaaaaaaa", 3: None, 4: "", 5: "x" * 50_000 + " Zürich AG " + "acme" * 20, 6: "the zürich ag"}
    names = {10: "Acme", 11: "acme corp", 12: "aaaa", 13: "the", 14: None, 15: "ZÜRICH AG", 16: "ACME", 17: "nowhere at all"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "i long, v string")
    found = {(r.t, r.n): r.hits for r in mentions.mentions(frame(texts).toDF("t", "text"), frame(names).toDF("n", "name"), "t", "text", "n", "name").collect()}
    expected = {}
    for (t, text), (n, name) in product(texts.items(), names.items()):
        if text and name and len(name) >= 4 and (hits := text.lower().count(name.lower())):
            expected[t, n] = min(8, hits)
    assert found == expected and found[5, 10] == 8


def test_names_meet_only_texts_that_hold_them():
    names = [b"und der wald", b"acme", b"a name of many more bytes than a piece"]
    known = np.zeros(1 << (mentions.BITS - 6), np.uint64)
    for x in (int(mentions._of_name(n)[0]) for n in names):
        for slot in (x >> (64 - mentions.BITS), x & ((1 << mentions.BITS) - 1)):
            known[slot >> 6] |= np.uint64(1 << (slot & 63))
    pieces = mentions._of_text(known)
    assert not len(pieces(b"und dex wald, und der walx, acm acne; a name of m, bytes than a piec")) and not len(pieces(b"")) and not len(pieces(b"acm"))
    assert [len(pieces(b"in " + n + b".")) for n in names] == [1, 1, 1]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_edits(spark, k):
    draw = random.Random(k)
    names = {"", "a", "b", "ab", "ba", "Zürich", "Zurich", "Customer#0000001", "Customer#0000002", "Customer#000001", "aaaa", "aaab"} | {"".join(draw.choices("ab", k=draw.randrange(1, 7))) for _ in range(60)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    frame = spark.createDataFrame([(n,) for n in [*names, *names, None]], "a string")
    found = {(r.a, r.b): r.edits for r in edits.within_edits(frame, frame.withColumnRenamed("a", "b"), "a", "b", k).collect()}
    assert found == {(a, b): d for a, b in product(names, names) if (d := distance(a, b)) <= k}


@pytest.mark.parametrize("strict", [False, True])
def test_intervals(spark, strict):
    draw = random.Random(5)

    def drawn(n):
        out = []
        for i in range(n):
            first = draw.randrange(-3000, 3000)
            out.append((i, draw.randrange(2), first, first + draw.choice([0, 1, 2, 7, 60, 800, 5000])))
        return [*out, (n, 0, 5, 4), (n + 1, 0, None, 3), (n + 2, None, 1, 2)]

    a, b = drawn(150), drawn(130)
    left, right = spark.createDataFrame(a, "i long, g long, f long, t long"), spark.createDataFrame(b, "j long, g long, p long, q long")
    found = [(r.i, r.j) for r in intervals.overlaps(left, right, ["g"], ("f", "t"), ("p", "q"), strict).collect()]
    meets = lambda f, t, p, q: (f < q and p < t) if strict else (f <= q and p <= t)
    valid = lambda rows: [r for r in rows if None not in r and r[2] <= r[3]]
    expected = [(x[0], y[0]) for x, y in product(valid(a), valid(b)) if x[1] == y[1] and meets(*x[2:], *y[2:])]
    assert sorted(found) == sorted(expected) and len(found) > 500


def test_a_frequent_key_is_spread_over_time(spark):
    """A thousand intervals of a day each, one after the other, of one key: bins keep them apart."""
    rows = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") * 10).alias("f"), (F.col("id") * 10 + 1).alias("t"))
    other = rows.toDF("g", "j", "p", "q")
    assert intervals.overlaps(rows, other, ["g"], ("f", "t"), ("p", "q")).count() == 1000


def test_search_edges(spark):
    rows = spark.createDataFrame([(1, "Acme Capital", "New York"), (2, "acme", None), (3, None, "acme of acme"), (4, "The Zürich-Fund (II)", "x"), (5, "", "")], "id long, title string, subtitle string")
    index = textindex.build_index(rows, "id", "title", "subtitle")
    queries = spark.createDataFrame([(1, "ACME"), (2, "zü fund"), (3, "  "), (4, None), (5, "a% c_"), (6, "nothing here"), (7, "of of")], "q long, phrase string")
    found = {}
    for r in textindex.search(index, queries, "q", "phrase", 5).orderBy("q", "place").collect():
        found.setdefault(r.q, []).append((r.id, r.score))
    assert found == {1: [(2, 500 + 120 + 40 + 50), (1, 400 + 120 + 40 + 50), (3, 15)], 2: [(4, 120 + 80 + 50)], 5: [(1, 120 + 80 + 50), (2, 80 + 50), (3, 30)], 7: [(3, 30)]}


def test_equal_phrases_are_searched_once(spark):
    """Copies of a phrase have its rows each, and only one of them meets the rows."""
    rows = spark.createDataFrame([(i, f"red bolt {i}", "steel") for i in range(20)], "id long, title string, subtitle string")
    index = textindex.build_index(rows, "id", "title", "subtitle")
    asked = spark.createDataFrame([(i, "Red  steel" if i else " ") for i in range(30)], "q long, phrase string")
    found = textindex.search(index, asked, "q", "phrase", 3)
    assert sorted((r.q, r.id, r.place) for r in found.collect()) == [(q, i, i + 1) for q in range(1, 30) for i in range(3)]
    assert "search-phrases" in found._jdf.queryExecution().toString()


def test_profiles_are_counted_in_bytes_of_whole_texts():
    import pyarrow as pa

    from ledgerline.plans.relational import CELLS, _profiles

    texts = ["the heath " * 3, "aaa", "\u00e9\u00e8 e", "123"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([t.encode() for t in texts])], ["doc_id", "text"])
    found = next(_profiles([batch])).column("h").to_pylist()
    for text, h in zip(texts, found, strict=True):
        counts = [(len(text) - len(text.replace(c, ""))) // len(c) for c in CELLS]
        assert h % 2**64 == sum(1 << (63 - i) for i, n in enumerate(counts) if n * 64 > sum(counts))


def test_counted_pairs_are_dealt_into_more_parts_as_rows_grow(spark):
    from ledgerline.operators import joins

    rows = spark.createDataFrame([(g, m) for g in range(40) for m in (1, 2, 2, g % 3 + 3)], "g int, m int")
    few, many = joins.counted_pairs(rows, "g", "m"), joins.counted_pairs(rows, "g", "m", 5)
    wanted = {(1, 2, 40)} | {(a, b + 3, n) for a in (1, 2) for b, n in enumerate((14, 13, 13))}
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == wanted
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (8, 32)


def test_mentions_in_many_groups(spark):
    """Names in several blocks and texts in several parts: every name meets every text once, and several ids of a name have rows each."""
    import random

    from ledgerline.operators import mentions

    draw = random.Random(5)
    words = ["acme", "acme corp", "a very long name of a firm", "beta", "Beta", "berét", "none such", "corp acme"]
    texts = [(i, None if i == 7 else " ".join(draw.choice([*words, "x", "ACME"]) for _ in range(12))) for i in range(40)]
    found = mentions.mentions(spark.createDataFrame(texts, "d long, text string"), spark.createDataFrame([(i, w) for i, w in enumerate(words)], "n int, name string"), "d", "text", "n", "name", 3, part=3, block=2).collect()
    expected = {(d, n): min(3, c) for d, text in texts if text for n, w in enumerate(words) if (c := text.lower().count(w.lower()))}
    assert {(r.d, r.n): r.hits for r in found} == expected and len(found) == len(expected)
