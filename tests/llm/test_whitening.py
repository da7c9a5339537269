"""Whitened vectors against numpy on the whole list, and the edge cases."""

import numpy as np
import pytest

from ledgerline.llm import whitening

VECTORS = "vec_id long, embedding array<float>, x string, off string, w string, pos string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], "a", "b", "c", "d", "e") for i, v in rows], VECTORS)


def plain(rows, k):
    """(ids, n, deviations, whitened up to sign, explained) of rows with whole vectors."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-10 * values[0]).sum()))
    return [i for i, _ in kept], n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(spark, rows, k=16):
    found = whitening.whiten(table(spark, rows), k).toPandas()
    ids, n, deviations, white, explained = plain(rows, k)
    assert len(found) == white.size and set(found.n) == {n} and list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    got = {}
    for r in found.itertuples():
        got.setdefault((r.deviation, r.component), []).append(r.whitened)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert sorted(found.groupby("component").deviation.apply(list)[1]) == sorted(deviations.tolist())
    for c in range(white.shape[1]):
        mine, theirs = np.array([got[d, c + 1][0] for d in deviations.tolist()]), white[:, c]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
    return found


def test_against_numpy(spark):
    draw = np.random.default_rng(5)
    scales = np.linspace(3, 0.2, 20)
    rows = [(i, (draw.normal(size=20) * scales).tolist()) for i in range(300)]
    compare(spark, rows)
    compare(spark, [*rows, *rows[:200]], 4)  # repeated rows weigh nothing in the fit


def test_edges(spark):
    draw = np.random.default_rng(6)
    good = [(i, [*(draw.normal(size=3) * (4, 2, 1)).tolist(), 0.5]) for i in range(40)]  # a dimension without variance
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0]), (52, [float("nan")] * 4), (53, [float("inf"), 0, 0, 0]), (54, [0, 0, 0, float("-inf")]), (55, [])]
    found = compare(spark, [*good, *bad, (None, [1.0, 2.0, 3.0, 0.5]), (3, [9.0, 9.0, 9.0, 0.5])])
    assert found.component.max() == 3 and found.vec_id.isna().sum() == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.001, 2.0])]])
def test_nothing_varies(spark, rows):
    found = whitening.whiten(table(spark, rows))
    assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_lengths_differ(spark):
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0])]))
