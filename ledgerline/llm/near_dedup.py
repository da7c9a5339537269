"""Near duplicates by a chosen-path similarity join on word shingles.

1. One pass over whole texts turns each document into a shingle set and keeps a
   narrow row: the set's size and hash, one-byte-per-function minhash sketch, and
   for each branch of each tree the minwise shingle chosen there.
2. Equal sets collapse into classes, which have ids of their own; only one
   document of each goes on.
3. Each tree sends a class to the nodes named by its chosen minwise shingles.
   Nodes with one class vanish. Classes of nodes above LIMIT classes or SET_LIMIT
   shingles are first confirmed against a few leaders of their largest node;
   classes that one leader's links join need not meet again. These nodes then
   branch by further minwise shingles, but for those whose classes are all joined
   already. What is still above the limits after DEPTH levels is dense and is
   dealt into those pairs of blocks that hold classes not joined. So no task holds
   more than two blocks, a family of near copies costs time in proportion to its
   size, and no class or pair is dropped.
4. A small node compares all its sketches; classes with a candidate partner
   become members of it. A pair that an earlier small node of the same level
   holds is left to that node.
5. Members' whole texts are fetched once (others stay behind a bit map of the members'
   hashes), and each node confirms its links on
   full sets by one incidence-matrix product. It emits a spanning forest of the
   links, not all pairs.
6. Components spread the smallest class along the forests, with pointer jumping.

Trees repeat until a pair at the threshold is missed by all of them with less
than 1 - RECALL; the sketch filter, which all trees share, misses it with about
3e-7. So a pair at the threshold is lost with about 1.0e-5 in all, and one of
greater similarity with less.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, table
from .wordhash import LOWER, mix, sequence_hashes, word_hashes

WORDS, THRESHOLD = 5, 75  # per cent
RECALL = 0.99999
#: Branches a node makes at each level; levels after the first; classes compared in a node, and their shingles (8 bytes each).
BRANCHES, DEPTH, LIMIT, SET_LIMIT = 2, 3, 2_048, 1 << 24
#: Leaders of a large node, about.
LEADERS = 16
FUNCTIONS = 64
#: Sketch bytes that a candidate pair shares at least: five deviations below 0.75 of FUNCTIONS.
SHARED = 30
#: Columns of the incidence matrix at a time.
COLUMNS = 4_096
#: Bits of the map that texts must hit before they are shuffled to the members: 4 MB at most, at every size.
MAP_BITS = 1 << 25


def trees(threshold: float, recall: float = RECALL) -> int:
    """Trees of BRANCHES first branches that miss a pair at the threshold with less than 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold) / BRANCHES)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of word sequences; a shorter text is one sequence, no words none."""
    hashes = word_hashes((text or b"").translate(LOWER).split())
    return np.unique(sequence_hashes(hashes, tuple(range(min(words, len(hashes))))) if len(hashes) else hashes)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 31, FUNCTIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def minwise(shingle_set: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each function the shingle of the set that is least under it."""
    low = shingle_set.astype(np.uint32)
    return shingle_set[(multipliers[:, None] * low[None, :]).argmin(axis=1)]


def _set_hash(shingle_set: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(shingle_set)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


SKETCHES = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, keys array<long>, sketch binary"


def _sketch(words: int, keys: int):
    """keys: first branches of all trees; branch k is chosen by function k."""

    def run(batches):
        multipliers = _multipliers()
        salt = np.arange(keys, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                if not len(s):
                    rows.append((0, 0, 0, [], b""))
                    continue
                least = minwise(s, multipliers)
                rows.append((len(s), *_set_hash(s.tobytes()), mix(least[:keys] + salt).view(np.int64).tolist(), (least >> np.uint64(56)).astype(np.uint8).tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [c.split()[0] for c in SKETCHES.split(", ")])

    return run


def _by_node(batches, columns: tuple[str, ...]):
    """(node, rows) of rows sorted by node; a node's rows may span batches."""
    at, held = None, []
    for batch in batches:
        for row in zip(batch.column("node").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != at:
                if held:
                    yield at, held
                at, held = row[0], []
            held.append(row[1:])
    if held:
        yield at, held


def _pairs_out(a: list[int], b: list[int], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], list(names))


def _like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b share SHARED sketch bytes."""
    return (a[:, None, :] == b[None, :, :]).sum(axis=2) >= SHARED


def _sketch_matrix(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), FUNCTIONS)


def _candidates(batches):
    """Leaf rows (node, cls, sketch, tags, k, leader) -> (cls, node) of classes with a candidate partner here.

    tags: 4 bytes for each first branch, 0 where the pair cannot be left to it; k: this node's branch. Classes of one
    leader (-1: none) are joined already and no partners.
    """
    found, nodes = [], []
    for node, rows in _by_node(batches, ("cls", "sketch", "tags", "k", "leader")):
        if len(rows) > 1:
            s = _sketch_matrix(rows)
            tags, k = np.array([r[2] for r in rows], np.int64).reshape(len(rows), -1), rows[0][3]
            leader, hit = np.array([r[4] for r in rows], np.int64), np.zeros(len(rows), bool)
            step = max(1, (1 << 22) // (len(rows) * FUNCTIONS))
            for a in range(0, len(rows), step):
                near = _like(s[a : a + step], s)
                near[np.arange(len(near)), a + np.arange(len(near))] = False
                near &= (leader[a : a + step, None] != leader[None, :]) | (leader[None, :] < 0)
                for earlier in range(k):
                    t = tags[:, earlier]
                    near &= (t[a : a + step, None] != t[None, :]) | (t[None, :] == 0)
                hit |= near.any(axis=0)
            found += [r[0] for r, h in zip(rows, hit, strict=True) if h]
            nodes += [node] * int(hit.sum())
        if len(found) >= 10_000:
            yield _pairs_out(found, nodes, ("cls", "node"))
            found, nodes = [], []
    yield _pairs_out(found, nodes, ("cls", "node"))


def _leader_candidates(batches):
    """Rows (node, cls, sketch, leader) -> (cls, node) of leaders, and of other classes that are like one of them."""
    for node, rows in _by_node(batches, ("cls", "sketch", "leader")):
        s, first = _sketch_matrix(rows), np.array([r[2] for r in rows])
        hit = first.copy()
        for at in range(0, len(rows), 512):
            hit[at : at + 512] |= _like(s[at : at + 512], s[first]).any(axis=1)
        found = [r[0] for r, h in zip(rows, hit, strict=True) if h]
        yield _pairs_out(found, [node] * len(found), ("cls", "node"))


def _member_sets(words: int, size: int = 4 << 20):
    """(cls, text, nodes) -> (node, cls, shingles), about size bytes at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for cls, text, nodes in zip(*(batch.column(c).to_pylist() for c in ("cls", "text", "nodes")), strict=True):
                s = shingles(text, words).tobytes()
                for node in nodes:
                    held.append((node, cls, s))
                    n += len(s)
                    if n >= size:
                        yield _set_rows(held)
                        held, n = [], 0
        if held:
            yield _set_rows(held)

    return run


def _set_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["node", "cls", "shingles"])


def linked(sets: list[np.ndarray], threshold: int = THRESHOLD) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= threshold * union, on full sets."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int32)
    both = np.zeros((m, m), np.float32)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = counts[inverse] > 1  # others add to no intersection but a set's own
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[inverse[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        block = np.zeros((m, COLUMNS), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        both += block @ block.T
    both = both.astype(np.int32)
    union = sizes[:, None] + sizes[None, :]
    union -= both
    union *= threshold
    both *= 100
    found = both >= union
    np.fill_diagonal(found, False)
    return found


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest by breadth-first search: (parent, child)."""
    new, edges = np.ones(len(links), bool), []
    for root in range(len(links)):
        if not new[root]:
            continue
        new[root], queue = False, [root]
        for v in queue:
            found = np.flatnonzero(links[v] & new)
            new[found] = False
            edges += [(v, int(w)) for w in found]
            queue += found.tolist()
    return edges


def _distinct_sets(rows: list[tuple[int, bytes]]) -> tuple[list[int], list[np.ndarray]]:
    """A node's classes once each (repeated rows of a document bring its set again), and their sets."""
    sets = {cls: np.frombuffer(s, np.uint64) for cls, s in rows}
    return list(sets), list(sets.values())


def _confirm(threshold: int):
    def run(batches):
        a, b = [], []
        for _, rows in _by_node(batches, ("cls", "shingles")):
            classes, sets = _distinct_sets(rows)
            if len(classes) > 1:
                for v, w in forest(linked(sets, threshold)):
                    a.append(min(classes[v], classes[w]))
                    b.append(max(classes[v], classes[w]))
            if len(a) >= 10_000:
                yield _pairs_out(a, b, ("a", "b"))
                a, b = [], []
        yield _pairs_out(a, b, ("a", "b"))

    return run


def _sorted_by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", "cls")


def _sizes(rows: DataFrame, limit: int, set_limit: int, name: str) -> DataFrame:
    """node, n, big, blocks of nodes with two classes or more that are not all of one leader.

    A table of its own, so that what joins it is joined from two shuffles, of which AQE splits a common node's.
    """
    n, s = F.col("n"), F.col("s")
    counts = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("leader").alias("low"), F.max("leader").alias("high")).filter("n > 1 and (low < 0 or low < high)")
    blocks = F.ceil(F.greatest(n / F.lit(limit / 2), s / F.lit(set_limit / 2))).cast("int")
    return stage(counts.select("node", "n", ((n > limit) | (s > set_limit)).alias("big"), blocks.alias("blocks")), name)


def _first_nodes(reps: DataFrame, limit: int, set_limit: int) -> tuple[DataFrame, DataFrame]:
    """A leaf table (node, cls, sketch, tags, k, leader) of the first level's small nodes, and (node, cls, sketch, n_shingles, n) of the others."""
    first = reps.select("cls", "n_shingles", F.posexplode("keys").alias("k", "node"), F.lit(-1).cast("long").alias("leader"))
    sizes = _sizes(first, limit, set_limit, "near-sizes")
    found = first.join(sizes, "node").groupBy("cls").agg(F.collect_list(F.struct("k", "node", "big", "n")).alias("found"))
    # At most one entry per first branch; the tag of a node that is branched again counts for nobody.
    tag = F.transform(F.filter("found", lambda x: ~x["big"]), lambda x: F.struct(x["k"].alias("k"), F.pmod(x["node"], F.lit((1 << 32) - 1)) + 1))
    with_sketch = found.withColumn("by_k", F.map_from_entries(tag)).join(reps.select("cls", "sketch", "n_shingles", F.size("keys").alias("n_keys")), "cls")
    tags = F.transform(F.sequence(F.lit(0), F.col("n_keys") - 1), lambda k: F.coalesce(F.try_element_at("by_k", k), F.lit(0).cast("long")))
    rows = stage(with_sketch.select("cls", "sketch", "n_shingles", tags.alias("tags"), F.explode("found").alias("f")).select("f.node", "cls", "sketch", "n_shingles", "tags", "f.k", "f.big", "f.n"), "near-nodes")
    small = rows.filter("not big").select("node", "cls", "sketch", "tags", "k", F.lit(-1).cast("long").alias("leader"))
    return small, rows.filter("big").select("node", "cls", "sketch", "n_shingles", "n")


def _with_leaders(big: DataFrame, limit: int, set_limit: int) -> DataFrame:
    """(node, cls, sketch, leader): each class in its largest node, which is dealt into blocks, each with all of the node's leaders."""
    largest = F.max_by(F.struct("node", "sketch", "n_shingles"), F.struct("n", "node")).alias("c")
    chosen = stage(big.groupBy("cls").agg(largest).select("cls", "c.*", F.lit(-1).cast("long").alias("leader")), "near-large")
    sized = chosen.drop("leader").join(_sizes(chosen, limit, set_limit, "near-large-sizes"), "node")
    leads = F.pmod(F.xxhash64("node", "cls", F.lit(1)), F.lit(1 << 30)) < F.lit(LEADERS << 30) / F.col("n")
    to = F.when(F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block(F.col("blocks")).cast("int")))
    dealt = sized.withColumn("leader", leads).select("node", "cls", "sketch", "leader", F.explode(to).alias("block"))
    return dealt.select(F.xxhash64("node", "block").alias("node"), "cls", "sketch", "leader")


def _branches(big: DataFrame, limit: int, set_limit: int, depth: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Leaf tables of the nodes that (node, cls, sketch, n_shingles, leader) branch into, and the rows of those still too large, if any."""
    leaves = []
    for level in range(1, depth + 1):
        # Which function a node branches by depends on the node, so classes of a node agree.
        child = [F.xxhash64("node", F.lit(level), F.lit(j), F.substring("sketch", (F.pmod(F.xxhash64("node", F.lit(j)), F.lit(FUNCTIONS)) + 1).cast("int"), F.lit(1))) for j in range(BRANCHES)]
        nodes = stage(big.select(F.explode(F.array(*child)).alias("node"), "cls", "sketch", "n_shingles", "leader"), f"near-branches{level}")
        rows = stage(nodes.join(_sizes(nodes, limit, set_limit, f"near-sizes{level}"), "node"), f"near-level{level}")
        leaves.append(_unowned(rows.filter("not big")))
        big = rows.filter("big").select(*nodes.columns)
        if big.isEmpty():
            return leaves, None
    return leaves, big


def _unowned(rows: DataFrame) -> DataFrame:
    return rows.select("node", "cls", "sketch", F.array().cast("array<long>").alias("tags"), F.lit(0).alias("k"), "leader")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("cls", "node"), blocks)


def _unjoined(dense: DataFrame, limit: int, set_limit: int) -> DataFrame:
    """A leaf table of dense nodes, whose nodes are the pairs of blocks that hold classes of different leaders, or of none."""
    n, s = F.count("*"), F.sum("n_shingles")
    parts = dense.groupBy("node", "leader").agg(F.ceil(F.greatest(n / F.lit(limit / 2), s / F.lit(set_limit / 2))).cast("int").alias("blocks"))
    # A node has about as many leaders as were drawn for it, so its list is short.
    lists = parts.groupBy("node").agg(F.collect_list(F.struct("leader", "blocks")).alias("parts"))
    sized = stage(parts.join(lists, "node"), "near-parts")
    others = F.filter("parts", lambda p: (p["leader"] != F.col("leader")) | (p["leader"] == -1))
    blocks = F.flatten(F.transform(others, lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda b: F.struct(p["leader"].alias("leader"), b.alias("block")))))
    mine = F.struct(F.col("leader").alias("leader"), _block(F.col("blocks")).cast("int").alias("block"))
    joined = dense.join(sized, ["node", "leader"]).select("node", "cls", "sketch", "leader", mine.alias("mine"), F.explode(blocks).alias("other"))
    return _unowned(joined.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "cls", "sketch", "leader"))


def components(edges: DataFrame) -> DataFrame:
    """v, label: for each vertex of edges (a, b) the smallest vertex it reaches."""
    both = stage(edges.select("a", "b").distinct().select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "near-links")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, F.col("v") == F.col("a")).select("v", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        at = labels.select(F.col("v").alias("at"), F.col("label").alias("further"))
        jumped = nearer.join(at, F.col("new") == F.col("at")).select("v", F.least("new", "further").alias("label"), "old")
        found = stage(jumped, "near-labels")
        if found.filter("label < old").isEmpty():
            return found.select("v", "label")
        labels = found.select("v", "label")


def _likely(rows: DataFrame, members: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """rows (text_hash) without most of those whose hash no member (rep_hash) has; for an exact join that follows.

    The map of the members' hashes has a fixed number of bits, so it is broadcast at every size: many members only let more rows through.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = members.select(at("rep_hash").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    place = F.bitmap_bit_position(at("text_hash"))
    byte = F.conv(F.hex(F.substring("map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(at("text_hash")) == F.col("part")).filter(hit).select(*rows.columns)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, limit: int = LIMIT, depth: int = DEPTH, set_limit: int = SET_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    threshold: per cent of the union. Documents without words, null and empty texts among them, are
    linked with nothing; null ids too, and their component is null. Each distinct set is a vertex of the
    graph: rows that repeat an id each have a row, and of different texts a component of
    their own unless these are linked. An empty table gives an empty result; other columns are ignored. A very long text
    is one task's row and its set 8 bytes a shingle; nodes of long texts are split by set_limit shingles.
    """
    found = _marked(docs, words, threshold, limit, depth, set_limit, id_col, text_col)
    return found.drop("text_hash")


def _marked(docs: DataFrame, words: int, threshold: int, limit: int, depth: int, set_limit: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates, with each row's text_hash."""
    keys = BRANCHES * trees(threshold / 100)
    if keys > FUNCTIONS:
        raise ValueError(f"a threshold of {threshold} needs {keys} branches, more than {FUNCTIONS} functions")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col).alias("text_hash"))
    sketches = stage(rows.mapInArrow(_sketch(words, keys), SKETCHES), "near-sketches")
    with_set = sketches.filter("n_shingles > 0 and doc_id is not null")
    chosen = F.min(F.struct("doc_id", "text_hash", "keys", "sketch")).alias("c")  # equal sets have equal keys and sketches
    reps = with_set.groupBy("h1", "h2").agg(chosen, F.first("n_shingles").alias("n_shingles")).select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", F.col("c.doc_id").alias("rep"), F.col("c.text_hash").alias("rep_hash"), "n_shingles", "c.keys", "c.sketch")
    reps = stage(reps, "near-reps")

    def confirmed(candidates: DataFrame, name: str) -> DataFrame:
        """Links (a, b) of the candidates (cls, node) that share a node, on whole sets."""
        nodes = candidates.groupBy("cls").agg(F.collect_set("node").alias("nodes")).join(reps.select("cls", "rep", "rep_hash"), "cls")
        # Members grow with the documents, so their texts, but hardly any others, come by a shuffle at every size.
        members = stage(nodes, f"near-members{name}")
        texts = _likely(rows, members).join(members.hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("cls", "text", "nodes")
        sets = texts.mapInArrow(_member_sets(words), "node long, cls long, shingles binary")
        return stage(_sorted_by_node(sets).mapInArrow(_confirm(threshold), "a long, b long"), f"near-edges{name}")

    small, big = _first_nodes(reps, limit, set_limit)
    leaves, edges = [small], []
    if not big.isEmpty():
        edges.append(confirmed(_sorted_by_node(_with_leaders(big, limit, set_limit)).mapInArrow(_leader_candidates, "cls long, node long"), "-leaders"))
        led = components(edges[0]).withColumnsRenamed({"v": "cls", "label": "leader"})
        joined = stage(big.drop("n").join(led, "cls", "left").withColumn("leader", F.coalesce("leader", F.lit(-1))), "near-joined")
        more, dense = _branches(joined, limit, set_limit, depth)
        leaves += more + ([] if dense is None else [_unjoined(dense, limit, set_limit)])
    parts = [_sorted_by_node(leaf).mapInArrow(_candidates, "cls long, node long") for leaf in leaves]
    edges.append(confirmed(reduce(DataFrame.unionByName, parts), ""))
    labels = components(reduce(DataFrame.unionByName, edges))

    linked_reps = stage(reps.select("cls", "h1", "h2", "rep").join(labels, F.col("cls") == F.col("v")).select("h1", "h2", "rep", "label"), "near-linked")
    smallest = linked_reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    alone = reps.select("h1", "h2", "rep").join(linked_reps.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("rep").alias("component_id"))
    of_class = stage(linked_reps.join(smallest, "label").select("h1", "h2", "component_id").unionByName(alone), "near-classes")
    narrow = ["doc_id", "text_hash", "n_shingles"]
    joined = with_set.select(*narrow, "h1", "h2").join(of_class, ["h1", "h2"]).select(*narrow, "component_id")
    without = sketches.filter("n_shingles = 0 or doc_id is null").select(*narrow, F.col("doc_id").alias("component_id"))
    return joined.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, limit: int = LIMIT, depth: int = DEPTH, set_limit: int = SET_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the document of smallest id of each component; same columns.

    Null and empty texts and null ids all stay. Rows that repeat an id and a text are one document, which stays or goes as a whole;
    rows that repeat an id with different texts are judged each. Columns of any name may stand beside; an empty table
    stays empty. Texts go through one shuffle, by id and a hash of the text.
    """
    kept_id, kept_hash, mine = fresh("kept_id", docs), fresh("kept_hash", docs), fresh("text_hash", docs)
    found = _marked(docs, words, threshold, limit, depth, set_limit, id_col, text_col).filter("kept")
    ids = found.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
    rows = docs.withColumn(mine, _text_hash(text_col))
    return rows.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(mine) == F.col(kept_hash)), "left_semi").select(*docs.columns)


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN s USING (doc_id) GROUP BY doc_id
"""
