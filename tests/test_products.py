"""Graph measures by products of blocks, against plain loops over graphs of several blocks with gaps in their ids."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import graph, joins, products


def web(nodes, chance, seed=1):
    """Undirected edges of a random graph with a chain at its end; ids have gaps and begin below 0."""
    rng = np.random.default_rng(seed)
    ids = np.sort(rng.choice(5_000, nodes, replace=False) - 700).tolist()
    half = nodes // 2
    pairs = [(ids[a], ids[b]) for a in range(half) for b in range(a + 1, half) if rng.random() < chance] + [(ids[a], ids[a + 1]) for a in range(half, nodes - 1)]
    weights = rng.choice([0.1, 0.2, 0.7, 1.0], len(pairs)).tolist()
    near = defaultdict(dict)
    for (a, b), w in zip(pairs, weights, strict=True):
        near[a][b] = near[b][a] = w
    return [(a, b, w) for (a, b), w in zip(pairs, weights, strict=True)], near


@pytest.mark.parametrize("chance", [0.02, 0.4])
def test_two_hops_and_constraint(spark, chance):
    pairs, near = web(300, chance)
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    middles = defaultdict(list)
    for via in near:
        for a in near[via]:
            for b in near[via]:
                if a != b and b not in near[a]:
                    middles[a, b].append(via)
    found = {(r.src, r.dst): (r.paths, r.via) for r in joins.two_hop(joins.undirected(edges)).collect()}
    assert found == {k: (len(v), min(v)) for k, v in middles.items()} and len(found) > 400
    asked = sorted(near)[::7]
    some = joins.two_hop(joins.undirected(edges), spark.createDataFrame([(i,) for i in asked], "id long")).collect()
    assert {(r.src, r.dst): (r.paths, r.via) for r in some} == {k: v for k, v in found.items() if k[0] in asked}

    total = {i: sum(near[i].values()) for i in near}
    share = {i: {j: w / total[i] for j, w in near[i].items()} for i in near}
    broker = {i: 1 - min(1, sum((share[i][j] + sum(share[i][q] * share[q].get(j, 0) for q in share[i])) ** 2 for j in share[i])) if len(share[i]) > 1 else 0 for i in near}
    scored = {r.id: r.broker for r in graph.constraint(edges).collect()}
    assert scored.keys() == broker.keys() and all(abs(scored[i] - broker[i]) < 1e-9 for i in broker)


def test_no_pair_of_edges_is_a_row(spark):
    """A hub's neighbours are not paired one by one: groups hold cells, of which there are few."""
    star = joins.undirected(spark.createDataFrame([(0, i) for i in range(1, 1_000)], "a long, b long"))
    whole = products.cells(star)
    assert whole.table.count() <= 2 * 8 and products.ways(whole.table, whole, whole.table, False).count().agg({"count": "sum"}).first()[0] <= 8 * 8 * 9


@pytest.mark.parametrize("chance", [0.02, 0.4])
def test_distances(spark, chance):
    pairs, near = web(300, chance)
    edges = joins.undirected(spark.createDataFrame(pairs, "a long, b long, weight double"))
    asked = [*sorted(near)[::3], 9_999]  # one without an edge
    expected = {}
    for source in asked:
        front, expected[source, source] = {source}, 0
        for level in (1, 2, 3):
            front = {j for i in front for j in near[i]} - {j for s, j in expected if s == source}
            expected |= {(source, j): level for j in front}
    found = [((r.src, r.id), r.distance) for r in graph.distances(edges, spark.createDataFrame([(i,) for i in asked], "id long"), 3).collect()]
    assert dict(found) == expected and len(found) == len(expected)


def test_every_supplier_has_a_neighbourhood(spark):
    from ledgerline.plans.catalog import QUERIES

    from .conftest import FOLDER

    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").collect()}
    assert {r.src for r in QUERIES["neighbourhood_3hop"](spark, FOLDER).collect()} == suppliers


def simple_paths(near, source, hops, step):
    """All simple paths from a node, with the sums of their edges' values."""
    todo = [((source,), 0.0)]
    for path, total in todo:
        if len(path) <= hops:
            todo += [((*path, j), total + step(path[-1], j)) for j in sorted(near[path[-1]]) if j not in path]
    return todo[1:]


@pytest.mark.parametrize("chance", [0.05, 0.5])
def test_paths(spark, monkeypatch, chance):
    """Few different values, so that many paths tie; groups of one block of nodes, and paths merged a few at a time."""
    from ledgerline.operators import walks

    whole, extended = walks.walks, walks._extended
    monkeypatch.setattr(walks, "walks", lambda *a: whole(*a, held=2_000))
    monkeypatch.setattr(walks, "_extended", lambda *a: extended(*a, some=50))
    pairs, near = web(60 if chance > 0.2 else 160, chance)
    edges = joins.undirected(spark.createDataFrame(pairs, "a long, b long, quality double"), "a", "b", "quality")
    asked = [*sorted(near)[::9], 9_999]
    sources = spark.createDataFrame([(i,) for i in asked], "id long")

    best = {i: sorted(near[i], key=lambda j: (-near[i][j], j))[:6] for i in near}
    expected = {}
    for source in asked[:-1]:
        to = defaultdict(list)
        for path, cost in simple_paths(best, source, 3, lambda a, b: 1 / (near[a][b] + 0.1)):
            to[path[-1]].append((round(cost, 9), len(path), path))
        expected |= {(source, j): [p[2] for p in sorted(paths)[:2]] for j, paths in to.items()}
    rows = graph.best_paths(edges, sources, F.lit(True), 3, 2, 6).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (round(r.cost, 9), len(r.path), tuple(r.path))):
        found[r.src, r.dst].append(tuple(r.path))
        assert abs(r.cost - sum(1 / (near[a][b] + 0.1) for a, b in zip(r.path, r.path[1:], strict=False))) < 1e-9
    assert found == expected

    expected = {}
    for source in asked[:-1]:
        to = defaultdict(list)
        for path, quality in simple_paths(near, source, 4 if chance < 0.2 else 3, lambda a, b: near[a][b]):
            to[path[-1]].append((len(path), -round(quality, 9), path))
        expected |= {(source, j): [p[2] for p in sorted(paths)[:3] if p[0] == min(paths)[0]] for j, paths in to.items()}
    rows = graph.shortest_paths(edges, sources, 4, 3).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-round(r.quality, 9), tuple(r.path))):
        assert r.hops == len(r.path) - 1
        found[r.src, r.dst].append(tuple(r.path))
    if chance < 0.2:
        assert found == expected
    else:
        assert all(found[k] == expected[k] for k in expected)


@pytest.mark.parametrize("size", [3, 40])
def test_months_and_groups_of_edges(spark, size):
    """Edges whose ends meet in small and in large groups, in one block and in several; open ends are null."""
    import datetime

    from ledgerline.operators import relations

    rng = np.random.default_rng(size)
    pairs, _ = web(40, 0.3)
    ids = sorted({i for a, b, _ in pairs for i in (a, b)})
    day = lambda: None if rng.random() < 0.1 else datetime.date(2000, 1, 1) + datetime.timedelta(int(rng.integers(900)))
    rows = [(f"g{g}", m, day(), day()) for g in range(30) for m in ids if rng.random() < (0.9 if g < 2 else 0.1)]
    edges = relations.blocks(spark.createDataFrame(pairs, "a long, b long, weight double").select("a", "b"), size=size)
    of = {m: {g: (s, e) for g, x, s, e in rows if x == m} for m in ids}
    expected = {}
    for a, b, _ in pairs:
        months, last = 0.0, []
        for g in of[a].keys() & of[b].keys():
            starts, ends = ([d[i] for d in (of[a][g], of[b][g]) if d[i]] for i in (0, 1))
            months += max(0, (min(ends) - max(starts)).days) / 30.44 if starts and ends else 0
            last += ends
        if months:
            expected[a, b] = (round(min(1, np.log1p(months) / np.log(37)), 6), max(last))
    groups = spark.createDataFrame(rows, "g string, m long, s date, e date")
    found = relations.overlap_signal(edges, groups, "g", "m", "s", "e", 36).collect()
    assert {(r.a, r.b): (round(r.value, 6), r.seen) for r in found} == expected and len(found) == len(expected) > 30


@pytest.mark.parametrize("groups, chance", [(7, 0.8), (300, 0.3), (5_000, 0.4)])
def test_shared_groups(spark, groups, chance):
    """Few groups that hold most members, and more than are multiplied at once; each block of members is packed once."""
    rng = np.random.default_rng(groups)
    ids = np.sort(rng.choice(10**12, 24, replace=False) - 10**11)
    held = rng.random((24, groups)) < chance
    rows = [(int(g * 17 - 50), int(ids[m])) for m, g in zip(*np.nonzero(held), strict=True)]
    n = held.astype(int) @ held.T.astype(int)
    expected = {(int(ids[a]), int(ids[b])): int(n[a, b]) for a in range(24) for b in range(a + 1, 24) if n[a, b]}
    found = products.counted(spark.createDataFrame(rows, "g long, m long"), "g", "m", 10).collect()
    assert {(r.a, r.b): r.n for r in found} == expected and len(found) == len(expected)
