"""Joins: latest-as-of, intervals, proximity, pairs, neighbours, overlays and audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import products


def latest_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; ties are broken by the order alone."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def latest_with_ties(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """All rows of each key that have its greatest value, by an aggregation and a join back."""
    last = rows.groupBy(*keys).agg(F.max(by).alias(by))
    return rows.join(last, [*keys, by], "left_semi")


def pairs_within(rows: DataFrame, group: str, member: str, most: int | None = None) -> DataFrame:
    """group, a, b with a < b: pairs of a group's distinct members, of its first `most` if given.

    A self-join on the group, so no group is ever one row; AQE splits one that very many members have.
    """
    each = rows.select(group, member).distinct()
    if most:
        first = F.row_number().over(Window.partitionBy(group).orderBy(member))
        each = each.withColumn("_r", first).filter(F.col("_r") <= most).drop("_r")
    return each.toDF(group, "a").join(each.toDF(group, "b"), group).filter("a < b")


def counted_pairs(rows: DataFrame, group: str, member: str, share: int = 500_000) -> DataFrame:
    """a, b, n with a < b: how many groups two members share; for groups that stay small.

    Rows and pairs are dealt into as many parts as hold about `share` rows each, and pairs are only counted where they
    come together, so what a task sorts and counts stays the same as the rows grow.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // share))
    each = rows.select(group, member).repartition(parts, group).distinct()
    pairs = each.toDF(group, "a").join(each.toDF(group, "b").hint("merge"), group).filter("a < b").select("a", "b")
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def pairs_equal_or_unknown(rows: DataFrame, id_col: str, keys: list[str], value: str) -> DataFrame:
    """a, b with a < b: pairs of equal keys whose values are equal or of which one is null.

    Known values meet by value and unknown ones meet all, so no pair is made and then dropped.
    """
    side = lambda df, name: df.select(*keys, F.col(value).alias("_v"), F.col(id_col).alias(name))
    known, unknown = rows.filter(F.col(value).isNotNull()), rows.filter(F.col(value).isNull())
    equal = side(known, "a").join(side(known, "b"), [*keys, "_v"]).filter("a < b").select("a", "b")
    none = side(unknown, "a").join(side(unknown, "b").drop("_v"), keys).filter("a < b").select("a", "b")
    one = side(unknown, "a").join(side(known, "b").drop("_v"), keys).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(none).unionByName(one)


def set_similarities(rows: DataFrame, owner: str, element: str) -> DataFrame:
    """a, b, shared, jaccard with a < b: all pairs of owners that share an element, by joins on the elements.

    The work is that of the pairs of owners of each element: elements that very many have should be left out before.
    """
    each = rows.select(F.col(owner).alias("o"), F.col(element).alias("e")).distinct()
    sizes = each.groupBy("o").agg(F.count("*").alias("n"))
    shared = each.toDF("a", "e").join(each.toDF("b", "e"), "e").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = shared.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return joined.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def near_hashes(rows: DataFrame, id_col: str, hash_col: str, most: int, prefix_bits: int = 16) -> DataFrame:
    """a, b, distance of 64-bit hashes: members of an equal hash with its smallest id (0), and such ids with each other (up to most).

    Hashes that differ must share their first bits and differ in `most` others at most. Of most + 1
    bands of the other bits one then agrees, so representatives meet by prefix and band, and
    a pair counts where its first agreeing band is; copies never meet each other.
    """
    h = F.col(hash_col)
    reps = rows.groupBy(h.alias("h")).agg(F.min(id_col).alias("rep"))
    same = rows.select(F.col(id_col).alias("b"), h.alias("h")).join(reps, "h").filter("b <> rep").select(F.col("rep").alias("a"), "b", F.lit(0).alias("distance"))
    rest, bands = 64 - prefix_bits, most + 1
    cuts = [rest * k // bands for k in range(bands + 1)]
    band = lambda x, k: F.shiftright(x, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    prefix = F.shiftrightunsigned(F.col("h"), rest)
    keyed = reps.select("rep", "h", prefix.alias("p"), F.posexplode(F.array(*(band(F.col("h"), k) for k in range(bands)))).alias("k", "v"))
    x, y = keyed.toDF("a", "ha", "p", "k", "v"), keyed.toDF("b", "hb", "p", "k", "v")
    met = x.join(y, ["p", "k", "v"]).filter("a < b")
    both = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.coalesce(*(F.when(band(both, k) == 0, k) for k in range(bands)))
    near = met.withColumn("distance", F.bit_count(both)).filter((F.col("distance") <= most) & (first == F.col("k"))).select("a", "b", "distance")
    return same.unionByName(near)


def near_in_time(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, days: int, left_id: str) -> DataFrame:
    """For each left row the right row of the same key that is nearest in time within days, ties by time.

    Times are bucketed by days, and a left row looks into its own bucket and both
    neighbours, so the join is an equi-join even where a key is frequent.
    """
    size = days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    probe = left.withColumn("_t", micros(left_time)).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_t") / size) + d)))
    build = right.withColumn("_u", micros(right_time)).withColumn("_bucket", F.floor(F.col("_u") / size))
    found = probe.join(build, [key, "_bucket"]).filter(F.abs(F.col("_t") - F.col("_u")) <= size)
    return latest_by(found, [left_id], F.abs(F.col("_t") - F.col("_u")), F.col("_u")).drop("_t", "_u", "_bucket")


def without_near(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, days: int, left_id: str) -> DataFrame:
    """Left rows for which near_in_time finds nothing."""
    found = near_in_time(left.select(left_id, key, left_time), right, key, left_time, right_time, days, left_id)
    return left.join(found.select(left_id), left_id, "left_anti")


def undirected(edges: DataFrame, a: str = "a", b: str = "b", *carry: str) -> DataFrame:
    """Both directions of every edge as src, dst."""
    there = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *carry)
    return there.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *carry))


def two_hop(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """src, dst, via, paths: for each source (id; by default every node) those two edges away that are no neighbours, with their distinct middles and the least of them.

    edges: src, dst in both directions, of integer ids. Middles are counted as products of blocks of the graph's matrix, so no pair of edges is shuffled.
    """
    return products.two_hop(edges.select("src", "dst"), sources).select("src", "dst", "paths", "via")


def overlay(facts: DataFrame, overrides: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Facts with locked overrides in their place: keys, value, overridden_attempt, origin.

    An override without a fact is appended; a replaced fact's value is kept as the attempt.
    """
    locked = overrides.select(*keys, F.col(value).alias("_manual"), F.lit(True).alias("_locked"))
    joined = facts.select(*keys, F.col(value).alias("_fact")).join(locked, keys, "full")
    has = F.coalesce("_locked", F.lit(False))
    return joined.select(*keys, F.when(has, F.col("_manual")).otherwise(F.col("_fact")).alias(value), F.when(has, F.col("_fact")).alias("overridden_attempt"), F.when(has, "override").otherwise("fact").alias("origin"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys are no orphans."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def _nearest(k: int, id_type: pa.DataType):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """A cell's k best of each query; ties by id. Products find what can be among them, whose cosines are then summed row by row, so that equal vectors tie."""
        matrix = lambda t, name: np.asarray(t.column(name).combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            ids, names, v, q = rows.column("id").to_numpy(), queries.column("query").to_numpy(), matrix(rows, "v"), matrix(queries, "q")
            for first in range(0, len(q), 256):
                some = q[first : first + 256]
                cosine = some @ v.T
                own = np.flatnonzero(np.isin(names[first : first + 256], ids))
                cosine[own] = np.where(names[first + own, None] == ids[None, :], -np.inf, cosine[own])
                least = np.full(len(some), -np.inf) if cosine.shape[1] <= k else cosine.max(axis=1) if k == 1 else np.partition(cosine, -k, axis=1)[:, -k]
                at, here = np.nonzero((cosine >= least[:, None] - 1e-9) & (cosine > -np.inf))
                exact = np.concatenate([np.empty(0), *((some[at[c : c + 65_536]] * v[here[c : c + 65_536]]).sum(axis=1) for c in range(0, len(at), 65_536))])
                order = np.lexsort((ids[here], -exact, at))
                at, here, exact = at[order], here[order], exact[order]
                best = np.arange(len(at)) - np.searchsorted(at, at) < k
                out[0].append(names[first : first + 256][at[best]])
                out[1].append(ids[here[best]])
                out[2].append(exact[best])
        query, found, cosine = (np.concatenate(x) if x else np.empty(0) for x in out)
        return pa.table({"query": pa.array(query, queries.schema.field("query").type) if len(query) else pa.array([], id_type), "id": pa.array(found, id_type) if len(found) else pa.array([], id_type), "cosine": pa.array(cosine, pa.float64())})

    return run


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", cell: int = 8_192) -> DataFrame:
    """query, id, cosine: the k nearest others of each query by cosine, ties by id; exact.

    Queries are a stated set that is compared with all rows. Both are dealt into blocks of about `cell`; each pair of blocks is a task's
    group, multiplied as matrices, so neither side is broadcast whatever its size, and the k best of each pair of blocks are found before
    those of a query meet. Pairs with a vector that is null, zero or not finite have no cosine to multiply for and are scored one by one.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    held = lambda df, name, v: df.select(F.col(id_col).alias(name), F.transform(vector, lambda x: x.cast("double")).alias(v))
    usable = lambda v: F.coalesce(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(dot(F.col(v), F.col(v))))
    # The length is computed once a vector, beside it.
    scaled = lambda df, name, v: df.withColumn("_n", F.sqrt(dot(F.col(v), F.col(v)))).select(name, F.transform(v, lambda x: x / F.col("_n")).alias(v), F.size(v).alias("width"))
    rows, asked = held(vectors, "id", "v"), held(queries, "query", "q")
    good, bad, fine, odd = rows.filter(usable("v")), rows.filter(~usable("v")), asked.filter(usable("q")), asked.filter(~usable("q"))
    blocks = lambda df: max(1, -(-df.count() // cell))
    n, m = blocks(vectors), blocks(queries)
    deal = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = scaled(good, "id", "v").select("id", "v", "width", deal("id", n).alias("cell"), every(m).alias("block"))
    right = scaled(fine, "query", "q").select("query", "q", "width", deal("query", m).alias("block"), every(n).alias("cell"))
    kind = dict(vectors.dtypes)[id_col]
    near = left.groupBy("width", "cell", "block").cogroup(right.groupBy("width", "cell", "block")).applyInArrow(_nearest(k, to_arrow_type(vectors.schema[id_col].dataType)), f"query {kind}, id {kind}, cosine double")
    single = lambda a, b: a.join(b).filter("id <> query").select("query", "id", dot(unit("q"), unit("v")).alias("cosine"))
    scored = near.unionByName(single(bad, asked)).unionByName(single(good, odd))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return scored.withColumn("r", best).filter(F.col("r") <= k).select("query", "id", "cosine")
