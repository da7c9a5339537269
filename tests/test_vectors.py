"""Inverted lists against all comparisons, on rows that fall into clusters."""

import numpy as np
import pytest

from ledgerline.operators import vectors


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    return centres[draw.integers(0, 40, 3000)] + 0.25 * draw.normal(size=(3000, 16))


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(frame):
    return vectors.build_lists(frame, 40)


def nearest(data, k):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -9)
    return np.argsort(-cosine, axis=1, kind="stable")[:, :k]


def test_recall_at_a_tenth_of_the_comparisons(frame, index, data):
    queries = frame.filter("vec_id % 50 = 0 and vec_id < 3000")
    found = {}
    for r in vectors.search(index, queries, 5, 2).collect():
        found.setdefault(r.query, set()).add(r.id)
    expected = nearest(data, 5)
    hits = sum(len(found[q] & set(expected[q].tolist())) for q in range(0, 3000, 50))
    assert len(found) == 60 and hits / 300 >= 0.95
    assert vectors.compared(index, queries, 2) <= 0.1 * 60 * 3000
    assert index.sizes.sum() == 3000 and index.rows.count() == 3000


@pytest.mark.parametrize("cell", [8_192, 50])
def test_exact(frame, index, data, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    queries = frame.filter("vec_id % 100 = 0")
    found = {}
    for r in vectors.search(index, queries, 7, 1, exact=True).orderBy("query", "cosine", ascending=[True, False]).collect():
        found.setdefault(r.query, []).append(r.id)
    expected = nearest(data, 7)
    assert found == {q: expected[q].tolist() for q in range(0, 3000, 100)}


def test_fewer_rows_than_asked(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    found = vectors.search(vectors.build_lists(few, 2), few, 10, 1, exact=True)
    assert found.groupBy("query").count().filter("count = 3").count() == 4


def test_top_k_by_blocks(spark):
    """Many small blocks, copies (ties by id), and vectors without a cosine, which come last."""
    from ledgerline.operators.joins import vector_top_k

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v = np.vstack([v, v[:20]])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None), (91, [None, 1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    found = vector_top_k(rows, rows.filter("vec_id % 10 = 0"), 4, cell=16).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 80, 10):
        cosine = np.round(unit @ unit[q], 12)
        expected = sorted((i for i in range(80) if i != q), key=lambda i: (-cosine[i], i))[:4]
        assert [r.id for r in sorted((r for r in found if r.query == q), key=lambda r: (-round(r.cosine, 12), r.id))] == expected
    assert [(r.id, r.cosine) for r in found if r.query == 90] == [(i, None) for i in range(4)]


def test_every_vector_is_resolved(spark):
    from ledgerline.plans.catalog import QUERIES

    from .conftest import FOLDER

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert sorted(r.vec_id for r in QUERIES["vector_resolve"](spark, FOLDER).collect()) == sorted(r.vec_id for r in rows.collect())
