"""Vector search on inverted lists around centroids, approximate by its nearest lists or exact by bounds on the others."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

#: Rows that centroids are fitted on, about; rows and queries of a cell, which one task compares.
SAMPLE, CELL = 20_000, 8_192
ROWS = "id long, v array<double>, list int, near double"


@dataclass
class Lists:
    """centroids: unit rows, one a list; rows: id, v (unit), list, near (cosine to its centroid); sizes and least cosine of each list."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: np.ndarray
    least: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                cosine = v @ centroids.T
                best = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _arrays(v), pa.array(best, pa.int32()), pa.array(cosine[np.arange(len(v)), best])], ["id", "v", "list", "near"])

    return run


def _usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v of rows with an id and a finite vector that isn't zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.when(finite & F.exists(v, lambda x: x != 0), v).alias("v")).filter("id is not null and v is not null")


def build_lists(rows: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> Lists:
    """Every usable row in the list of its nearest centroid. Centroids are fitted by MLlib on about `sample` rows, drawn by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = _usable(rows, id_col, vector)
    share = min(1.0, sample / max(1, usable.count()))
    drawn = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, lists), seed=seed, maxIter=10, distanceMeasure="cosine").fit(staged(drawn.select("features"), "list-sample"))
    centroids = np.array(model.clusterCenters())
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    held = staged(usable.mapInArrow(_assign(centroids), ROWS), "lists")
    sizes, least = np.zeros(len(centroids), np.int64), np.ones(len(centroids))
    for r in held.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("least")).collect():  # one row a list
        sizes[r.list], least[r.list] = r.n, r.least
    return Lists(centroids, held, sizes, least)


def _probes(index: Lists, n: int, bound: bool):
    """(id, v[, kth]) -> (query, q, list): the n nearest lists of each query, or with bound those others that can hold something as near as kth.

    By the triangle inequality of angles nothing in a list is nearer to a query than the angle between the query and the centroid less
    that of the centroid and the list's farthest row.
    """
    centroids, sizes, width = index.centroids, index.sizes, np.arccos(np.clip(index.least, -1, 1))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("v"))
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            cosine = q @ centroids.T
            chosen = np.zeros(cosine.shape, bool)
            np.put_along_axis(chosen, np.argsort(-cosine, axis=1)[:, :n], True, axis=1)
            if bound:
                least = np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - width)
                chosen = ~chosen & (np.cos(least) >= batch.column("kth").to_numpy()[:, None] - 1e-9)
            at, lists = np.nonzero(chosen & (sizes > 0))
            for first in range(0, len(at), 8_192):
                some = at[first : first + 8_192]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), _arrays(q[some]), pa.array(lists[first : first + 8_192], pa.int32())], ["query", "q", "list"])

    return run


def _compare(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """A cell's best k of each query; ties by id."""
        ids, out = rows.column("id").to_numpy(), ([], [], [])
        if len(ids) and queries.num_rows:
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], _matrix(rows.column("v").combine_chunks())[order]
            names, q = queries.column("query").to_numpy(), _matrix(queries.column("q").combine_chunks())
            for first in range(0, len(q), 256):
                cosine = q[first : first + 256] @ v.T
                cosine[names[first : first + 256, None] == ids[None, :]] = -np.inf
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(cosine, best, axis=1)
                here = np.isfinite(found)
                out[0].append(np.repeat(names[first : first + 256], here.sum(axis=1)))
                out[1].append(ids[best][here])
                out[2].append(found[here])
        flat = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query": pa.array(flat[0], pa.int64()), "id": pa.array(flat[1], pa.int64()), "cosine": pa.array(flat[2], pa.float64())})

    return run


def _within(index: Lists, probes: DataFrame, k: int) -> DataFrame:
    """query, id, cosine: the best k of each query in the lists that it probes.

    A list is dealt into cells of about CELL rows, and the queries that probe it into blocks of as many; each pair of them is a task's group.
    """
    probes = staged(probes, "probes")
    asked = np.zeros(len(index.sizes), np.int64)
    for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row a list
        asked[r.list] = r.n
    parts = lambda n: F.array(*(F.lit(max(1, math.ceil(x / CELL))) for x in n.tolist()))
    rows, blocks = (F.get(parts(n), F.col("list")) for n in (index.sizes, asked))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    held = index.rows.withColumn("cell", deal("id", rows)).withColumn("block", every(blocks)).select("id", "v", F.col("list").alias("l"), "cell", "block")
    dealt = probes.withColumn("block", deal("query", blocks)).withColumn("cell", every(rows)).select("query", "q", "list", F.col("cell").alias("c"), F.col("block").alias("b"))
    return held.groupBy("l", "cell", "block").cogroup(dealt.groupBy("list", "c", "b")).applyInArrow(_compare(k), "query long, id long, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("_r", first).filter(F.col("_r") <= k).drop("_r")


def search(index: Lists, queries: DataFrame, k: int, probes: int, exact: bool = False, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, id, cosine: for each query k rows of greatest cosine, itself left out; ties by id.

    Rows of the query's `probes` nearest lists are compared. With exact, a second round compares those of all lists whose bound is not below the
    k-th best so far, so that nothing is lost: how many those are depends on how well the data fall into lists.
    """
    asked = staged(_usable(queries, id_col, vector), "queries")
    kind = "query long, q array<double>, list int"
    near = _best(_within(index, asked.mapInArrow(_probes(index, probes, False), kind), k), k)
    if not exact:
        return near
    near = staged(near, "nearest")
    kth = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("kth"))
    open_ = asked.join(kth, F.col("id") == F.col("query"), "left").select("id", "v", F.coalesce("kth", F.lit(-1.0)).alias("kth"))
    more = _within(index, open_.mapInArrow(_probes(index, probes, True), kind), k)
    return _best(near.unionByName(more), k)


def compared(index: Lists, queries: DataFrame, probes: int, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """How many rows, centroids included, a search without exact compares with its queries."""
    met = _usable(queries, id_col, vector).mapInArrow(_probes(index, probes, False), "query long, q array<double>, list int")
    counts = {r.list: r.n for r in met.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    return sum(int(index.sizes[i]) * n for i, n in counts.items()) + len(index.sizes) * queries.count()
