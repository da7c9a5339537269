"""Transitive closure of merges: canonical ids of duplicate pairs, and what follows for roles, facts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import discard, staged

#: Rounds after which something must be wrong: a chain of 2^30 vertices needs fewer.
ROUNDS = 64


def _nearest(links: DataFrame) -> DataFrame:
    """u, m: of each u its least v, of links u, v."""
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the least id) of every vertex of undirected edges, by alternating contractions.

    A large-star step links the greater neighbours of a vertex to the least vertex it knows, a small-star step its lesser ones. Edges
    never become more, chains shrink by half or better a round, and the end is a star around each component's least vertex. Vertices
    with very many neighbours are joined, never gathered. Edges with a null end, and loops, link nothing; a vertex
    that has only those isn't in the result. Each step is a table in the shared folder, and the one before is removed.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    links = staged(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "closure")
    before = None
    for _ in range(ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "closure-large")
        least = _nearest(large)
        lesser = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(lesser.unionByName(least.withColumnRenamed("m", "v")).distinct(), "closure")
        discard(links)
        discard(large)
        links, state = small, _state(small)
        if state == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def canonical_ids(pairs: DataFrame, a: str = "a", b: str = "b", standing: DataFrame | None = None) -> DataFrame:
    """id, canonical_id, n of everything in duplicate pairs.

    The canonical one of a component is that of best standing (id, standing: the smaller the better, null last), ties and without standings
    by the smaller id.
    """
    found = components(pairs, a, b)
    if standing is None:
        best = found.groupBy("component").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n"))
    else:
        ranked = found.join(standing.select("id", "standing"), "id", "left")
        order = F.struct(F.col("standing").isNull(), "standing", "id")
        best = ranked.groupBy("component").agg(F.min_by("id", order).alias("canonical_id"), F.countDistinct("id").alias("n"))
    return found.join(best, "component").select("id", "canonical_id", "n")


def _moved(rows: DataFrame, column: str, canonical: DataFrame, into: str) -> DataFrame:
    ids = canonical.select(F.col("id").alias(column), F.col("canonical_id").alias(into))
    return rows.join(ids, column, "left").withColumn(into, F.coalesce(into, column))


def unite_roles(roles: DataFrame, canonical: DataFrame, entity: str = "entity_id", role: str = "role") -> DataFrame:
    """entity, role, is_primary, confidence: the roles of all that became one, each with the greatest of its marks."""
    moved = _moved(roles, entity, canonical, "_to")
    return moved.groupBy(F.col("_to").alias(entity), role).agg(F.max("is_primary").alias("is_primary"), F.max("confidence").alias("confidence"))


def move_facts(facts: DataFrame, canonical: DataFrame, keys: list[str], fact_id: str, entity: str = "entity_id", current: str = "is_current") -> DataFrame:
    """Facts of the canonical entity; of several current ones of equal keys (nulls are equal) its own stays current, else that of the smallest id."""
    moved = _moved(facts, entity, canonical, "_to").withColumn("_own", F.col("_to") == F.col(entity))
    first = F.row_number().over(Window.partitionBy("_to", *keys, current).orderBy(F.desc("_own"), fact_id))
    kept = F.when((F.col(current) == 1) & (first > 1), 0).otherwise(F.col(current)).cast(dict(facts.dtypes)[current])
    marked = moved.withColumn("_kept", kept)
    return marked.select(*(F.col("_to").alias(c) if c == entity else F.col("_kept").alias(c) if c == current else F.col(c) for c in facts.columns))


def move_edges(edges: DataFrame, canonical: DataFrame, keys: list[str], edge_id: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between canonical entities without loops; of several with equal ends and keys (nulls are equal) one that did not move, else that of the smallest id."""
    moved = _moved(_moved(edges, src, canonical, "_s"), dst, canonical, "_d").filter("_s <> _d")
    stood: Column = (F.col("_s") == F.col(src)) & (F.col("_d") == F.col(dst))
    first = F.row_number().over(Window.partitionBy("_s", "_d", *keys).orderBy(F.desc(stood), edge_id))
    ends = {src: "_s", dst: "_d"}
    return moved.withColumn("_r", first).filter("_r = 1").select(*(F.col(ends[c]).alias(c) if c in ends else F.col(c) for c in edges.columns))
