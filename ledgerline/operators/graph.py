"""Graph measures over edge tables: PageRank, constraint, degrees, paths and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def staged(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in spark.checkpoint.dir, so that a loop's plan stays short and survives lost executors."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a staged table that nothing will read again, as a loop's last but one."""
    spark, path = table.sparkSession, getattr(table, "_staged_at", None)
    if path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, id, rank of the nodes of edges (keys, src, dst, weight); each combination of keys is a graph of its own.

    Weights are clamped to 0..1; edges whose weight is 0, null or NaN are dropped. Nodes without an
    outgoing edge spread their rank over all nodes. Stops when the summed change
    is below the tolerance in every graph, or after so many rounds.
    """
    k = list(keys)
    edges = edges.select(*k, "src", "dst", F.least(F.greatest(F.nanvl(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("weight")).filter("weight > 0")
    nodes = edges.select(*k, F.explode(F.array("src", "dst")).alias("id")).distinct()
    out = edges.groupBy(*k, F.col("src").alias("id")).agg(F.sum("weight").alias("out"))
    size = nodes.groupBy(*k).agg(F.count("*").alias("n")) if k else nodes.agg(F.count("*").alias("n"))
    links = staged(edges.join(out.withColumnRenamed("id", "src"), [*k, "src"]).select(*k, "src", "dst", (F.col("weight") / F.col("out")).alias("part")), "rank-links")
    base = nodes.join(size, k) if k else nodes.crossJoin(F.broadcast(size))
    ranks = staged(base.join(out, [*k, "id"], "left").select(*k, "id", "n", F.col("out").isNull().alias("dangling"), (1.0 / F.col("n")).alias("rank"), F.lit(1.0).alias("change")), "rank")
    for _ in range(rounds):
        lost = ranks.groupBy(*k).agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)).alias("lost"))
        came = links.join(ranks.select(*k, F.col("id").alias("src"), "rank"), [*k, "src"]).groupBy(*k, F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("part")).alias("came"))
        joined = ranks.join(came, [*k, "id"], "left")
        joined = joined.join(lost, k) if k else joined.crossJoin(F.broadcast(lost))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("came", F.lit(0.0)) + F.col("lost") / F.col("n"))
        before, ranks = ranks, staged(joined.select(*k, "id", "n", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "rank")
        discard(before)
        worst = ranks.groupBy(*k).agg(F.sum("change").alias("c")).agg(F.max("c")).first()[0]
        if worst is None or worst < tolerance:
            break
    return ranks.select(*k, "id", "rank")


def constraint(edges: DataFrame) -> DataFrame:
    """id, broker: 1 less Burt's constraint (clamped), of undirected edges a, b, weight; 0 with fewer than two neighbours.

    p is an edge's share of a node's weight. A node's constraint sums, over its neighbours j,
    (p_ij + sum over q of p_iq * p_qj) squared; the inner sum is a product of the matrix of shares
    with itself, taken at the edges only, block by block. Ids are integers.
    """
    from . import products

    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), "weight")).groupBy("i", "j").agg(F.max("weight").alias("weight"))
    both = staged(both, "edges")
    total = staged(both.groupBy("i").agg(F.sum("weight").alias("total"), F.count("*").alias("degree")), "totals")
    p = both.join(total, "i").select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("weight") / F.col("total")).alias("p"))
    joined = total.withColumnRenamed("i", "id").join(products.squares(p, "p"), "id", "left")
    return joined.select("id", F.when(F.col("degree") >= 2, 1 - F.least(F.lit(1.0), "squares")).otherwise(0.0).alias("broker"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree, strength of undirected edges a, b, weight."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def best_paths(edges: DataFrame, sources: DataFrame, target: Column, hops: int = 3, k: int = 5, cap: int = 200) -> DataFrame:
    """src, dst, path, cost: each source's k cheapest simple paths of at most `hops` to nodes that target selects (dst).

    edges: src, dst, quality in both directions, of integer ids; an edge costs 1 / (quality + 0.1), and each node
    takes its `cap` best neighbours. With three hops, of the paths to a node before the last only the
    k + 1 cheapest can be part of a result, since one of them at most holds the target already.
    Costs are compared to nine places: sums of the same edges in another order are ties, which the shorter and then the lesser path wins.
    """
    from .products import cells
    from .walks import walks

    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("quality"), "dst"))
    step = edges.withColumn("_r", first).filter(F.col("_r") <= cap).select("src", "dst", (-1 / (F.col("quality") + 0.1)).alias("w"))
    # Values are negative costs, so that of parallel edges the cheapest counts.
    found = walks(cells(step, "w"), sources, hops, k, [k + 1 if hops == 3 and level == 2 else k if level == hops else None for level in range(1, hops + 1)], -1, False)
    return found.select("src", "dst", "path", (-F.col("v")).alias("cost")).filter(target)


def shortest_paths(edges: DataFrame, sources: DataFrame, hops: int = 4, k: int = 5) -> DataFrame:
    """src, dst, hops, path, quality: of each source's shortest paths to every node, the k of greatest summed quality.

    edges: src, dst, quality in both directions, of integer ids. Level by level, each new node keeps its k best paths; a
    shortest path's parts are shortest and a best one's parts are among the k best, so nothing is lost.
    """
    from .products import cells
    from .walks import walks

    return walks(cells(edges, "quality"), sources, hops, k, [k] * hops, -1, True).withColumnRenamed("v", "quality")


def distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """src, id, distance: nodes within so many hops of each source (id), level by level. edges: src, dst in both directions, of integer ids."""
    from . import products

    start = sources.select(F.col("id").cast("long").alias("src"), F.col("id").cast("long").alias("id"), F.lit(0).alias("distance")).distinct()
    return start.unionByName(products.reach(edges.filter("src <> dst"), sources, hops)) if hops else start


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit_logistic(rows: DataFrame, features: list[str], label: str, epochs: int = 200, rate: float = 0.1, l2: float = 0.01, least: int = 25) -> list[float] | None:
    """Bias and weights by full-batch gradient descent; None with fewer rows than least, or one class only.

    Each epoch is one aggregation over the rows, so only the gradient reaches the driver.
    """
    y = F.col(label).cast("double")
    rows = staged(rows.select(*features, label), "train")
    n, positive = rows.agg(F.count("*"), F.sum(y)).first()
    if n < least or not 0 < positive < n:
        return None
    w = [0.0] * (len(features) + 1)
    for _ in range(epochs):
        z = sum((F.col(f) * v for f, v in zip(features, w[1:], strict=True)), F.lit(w[0]))
        off = sigmoid(z) - y
        g = rows.agg(F.avg(off), *(F.avg(off * F.col(f)) for f in features)).first()
        w = [w[0] - rate * g[0], *(v - rate * (d + l2 * v) for v, d in zip(w[1:], g[1:], strict=True))]
    return w
