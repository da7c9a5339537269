"""Projections, filters, joins, windows, ranking and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, search
from ..operators.aggregate import daily_outer
from ..operators.graph import staged
from ..operators.mentions import mentions
from .registry import query


@query("SELECT upper(c_name) AS name, lower(c_mktsegment) AS segment, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS in_credit, regexp_replace(c_name, '\\D', '', 'g') AS digits FROM customer")
def export_projection_transforms(t):
    return search.project(t.customer, {"name": ("c_name", "upper"), "segment": ("c_mktsegment", "lower"), "in_credit": (F.col("c_acctbal") > 0, "bool_yn"), "digits": ("c_name", "digits")})


@query("""SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (contains(lower(c_name), '00') OR contains(lower(n_name), '00')) AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_acctbal >= 1000 AND c_acctbal <= 8000""")
def filter_builder(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.filter(search.filters("00", ("c_name", "n_name"), {"c_mktsegment": ["BUILDING", "MACHINERY", "FURNITURE"], "n_name": []}, {"c_acctbal": 1000}, {"c_acctbal": 8000})).select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') ORDER BY c_acctbal DESC, c_custkey LIMIT 26 OFFSET 5""")
def entity_search(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    found = t.customer.filter("c_mktsegment = 'BUILDING'").join(urgent, "c_custkey", "left_semi")
    return search.page(found, [F.desc("c_acctbal"), F.asc("c_custkey")], 26, 5).select("c_custkey", "c_acctbal")


@query("WITH r AS (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_quantity < 3 GROUP BY 1) SELECT l_suppkey, lo, hi FROM r WHERE hi >= 1000 AND lo <= 1200")
def overlap_range(t):
    ranges = t.lineitem.filter("l_quantity < 3").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return ranges.filter(search.overlaps("lo", "hi", 1000, 1200))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) IN (7, 42)")
def json_contains(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k")).filter(F.array_contains(F.array(F.lit(7), F.lit(42)).cast("array<bigint>"), F.col("k")))


@query("""WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY 1) SELECT o_custkey, len(p) AS kinds FROM a WHERE list_contains(p, '1-URGENT') AND EXISTS (SELECT 1 FROM (SELECT unnest(p) AS x) WHERE x LIKE '%LOW')""")
def json_array_contains(t):
    """Membership and an existential test on a JSON array's elements."""
    from ..operators.search import json_array

    as_json = t.orders.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_set("o_orderpriority"))).alias("j"))
    values = as_json.select("o_custkey", json_array(F.col("j")).alias("p"))
    return values.filter(F.array_contains("p", "1-URGENT") & F.exists("p", lambda x: x.endswith("LOW"))).select("o_custkey", F.size("p").cast("long").alias("kinds"))


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red') AND list_has_any(string_split(lower(p_name), ' '), ['widget', 'bolt'])")
def tags_all_any(t):
    tags = F.split(F.lower("p_name"), " ")
    return t.part.filter(F.forall(F.array(F.lit("red")), lambda x: F.array_contains(tags, x)) & F.arrays_overlap(tags, F.array(F.lit("widget"), F.lit("bolt")))).select("p_partkey")


@query("""WITH m AS (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS b FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')) AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1')))
SELECT p_partkey, CAST(CASE WHEN n = 'red' THEN 500 WHEN starts_with(n, 'red') THEN 400 WHEN contains(n, 'red') THEN 250 ELSE 0 END
+ CASE WHEN len(list_filter(string_split(n, ' '), lambda x: starts_with(x, 'red'))) > 0 THEN 120 ELSE 0 END
+ CASE WHEN contains(n, 'red') THEN 40 ELSE 0 END + CASE WHEN contains(b, 'red') THEN 15 ELSE 0 END + CASE WHEN contains(n, '1') THEN 40 ELSE 0 END + CASE WHEN contains(b, '1') THEN 15 ELSE 0 END
+ CASE WHEN length(n) < 12 THEN 50 ELSE 0 END AS INTEGER) AS rank FROM m""")
def token_search_ranked(t):
    tokens = ["red", "1"]
    found = t.part.filter(search.tokens_match(tokens, ["p_name", "p_brand"]))
    return found.select("p_partkey", search.search_rank(F.col("p_name"), F.col("p_brand"), "red", tokens).alias("rank"))


@query("""SELECT c_custkey, m FROM (SELECT c_custkey, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 480000 GROUP BY 1) ORDER BY m DESC NULLS LAST, c_custkey LIMIT 60""")
def null_ordering_page(t):
    large = t.orders.filter("o_totalprice > 480000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return search.page(t.customer.select("c_custkey").join(large, "c_custkey", "left"), [F.desc_nulls_last("m"), F.asc("c_custkey")], 60)


LADDER = [(r"promo|large", "top"), (r"econ", "entry"), (r"standard|medium", "middle")]


@query("SELECT p_type, CASE WHEN regexp_matches(lower(p_type), 'promo|large') THEN 'top' WHEN regexp_matches(lower(p_type), 'econ') THEN 'entry' WHEN regexp_matches(lower(p_type), 'standard|medium') THEN 'middle' ELSE 'other' END AS level, count(*) AS n FROM part GROUP BY 1, 2")
def title_ladder_classify(t):
    return t.part.groupBy("p_type", search.ladder(F.col("p_type"), LADDER, "other").alias("level")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative balance' WHEN c_nationkey > 20 THEN 'outside region' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'segment excluded' END AS reason FROM customer")
def hard_filter_reasons(t):
    reason = search.first_failure([("negative balance", F.col("c_acctbal") < 0), ("outside region", F.col("c_nationkey") > 20), ("segment excluded", F.col("c_mktsegment") == "HOUSEHOLD")])
    return t.customer.select("c_custkey", reason.alias("reason"))


@query("""SELECT r_name, p_type, count(*) AS n, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""")
def join_inner_4way(t):
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    lines = t.lineitem.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    joined = lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("r_name", "p_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))), 2).cast("double").alias("revenue"))


@query("SELECT c_custkey, n_name, coalesce(n, 0) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_enrich(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT e.user_id, count(*) AS n, any_value(c_mktsegment) AS segment FROM events e LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = CAST(e.user_id AS VARCHAR) GROUP BY 1")
def cast_key_view(t):
    keyed = t.customer.select(F.col("c_custkey").cast("string").alias("legacy_id"), "c_mktsegment")
    counts = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.join(keyed, F.col("user_id").cast("string") == F.col("legacy_id"), "left").select("user_id", "n", F.col("c_mktsegment").alias("segment"))


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def cooccurrence_pairs(t):
    return supplier_pairs(t)


@query("""WITH m AS (SELECT o_custkey, list_sort(list(DISTINCT CAST(left(o_orderpriority, 1) AS INTEGER) * 10000 + year(o_orderdate)))[1:5] AS m FROM orders GROUP BY 1), x AS (SELECT o_custkey, unnest(m) AS v FROM m)
SELECT a.v AS a, b.v AS b, count(*) AS n FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.v < b.v GROUP BY 1, 2""")
def pairs_capped(t):
    rows = t.orders.select("o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") * 10000 + F.year("o_orderdate")).alias("v"))
    return joins.pairs_within(rows, "o_custkey", "v", 5).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal < 2000 THEN NULL ELSE CAST(floor(s_acctbal / 2000) AS INTEGER) END AS y FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM d a JOIN d b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND (a.y = b.y OR a.y IS NULL OR b.y IS NULL)""")
def pairs_null_tolerant(t):
    year = F.when(F.col("s_acctbal") >= 2000, F.floor(F.col("s_acctbal") / 2000))
    return joins.pairs_equal_or_unknown(t.supplier.select("s_suppkey", "s_nationkey", year.alias("y")), "s_suppkey", ["s_nationkey"], "y")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def semi_touched(t):
    return t.customer.join(t.orders.filter("o_totalprice > 490000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_coverage_gaps(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, o_totalprice FROM orders a WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders b WHERE b.o_custkey = a.o_custkey)")
def latest_grouped(t):
    return joins.latest_with_ties(t.orders, ["o_custkey"], "o_orderdate").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) = 1")
def latest_row_number(t):
    return joins.latest_by(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH u AS (SELECT user_id AS k, 0 AS pref, ts, event_id AS id, event_type AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 1, ts, event_id, event_type FROM events WHERE event_type IN ('signup', 'view'))
SELECT k, v, id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY pref, ts DESC, id) = 1""")
def preference_pick(t):
    pref = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    rows = t.events.filter(F.col("event_type").isin("purchase", "signup", "view")).select(F.col("user_id").alias("k"), pref.alias("pref"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("v"))
    return joins.latest_by(rows, ["k"], F.asc("pref"), F.desc("ts"), F.asc("id")).select("k", "v", "id")


_MOVES = "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT event_id AS other, user_id, ts AS u FROM events WHERE event_type = 'purchase') "


@query(_MOVES + """SELECT event_id, other FROM l JOIN r USING (user_id) WHERE abs(epoch_us(ts) - epoch_us(u)) <= 86400000000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(u)), u) = 1""")
def interval_corroborate(t):
    left = t.events.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("at"))
    return joins.near_in_time(left, right, "user_id", "ts", "at", 1, "event_id").select("event_id", "other")


@query(_MOVES + "SELECT event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND abs(epoch_us(ts) - epoch_us(u)) <= 86400000000)")
def proximity_anti(t):
    left = t.events.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    return joins.without_near(left, right, "user_id", "ts", "at", 1, "event_id").select("event_id")


@query("""WITH w AS (SELECT l_suppkey, min(l_shipdate) AS a, min(l_shipdate) + INTERVAL 365 DAY AS b FROM lineitem GROUP BY 1)
SELECT l.l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS usd FROM lineitem l JOIN w ON w.l_suppkey = l.l_suppkey AND l_shipdate BETWEEN a AND b GROUP BY 1""")
def portfolio_window(t):
    first = F.min("l_shipdate").over(Window.partitionBy("l_suppkey"))
    inside = t.lineitem.select("l_suppkey", "l_shipdate", "l_extendedprice", first.alias("a")).filter(F.col("l_shipdate") <= F.col("a") + F.expr("INTERVAL 365 DAY"))
    return inside.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("usd"))


@query("""WITH a AS (SELECT extract(dow FROM ts) AS d, hour(ts) AS h, count(*) AS events FROM events WHERE event_type = 'error' GROUP BY 1, 2), b AS (SELECT extract(dow FROM o_orderdate) AS d, month(o_orderdate) AS h, count(*) AS orders FROM orders GROUP BY 1, 2)
SELECT CAST(coalesce(a.d, b.d) AS INTEGER) * 100 + coalesce(a.h, b.h) AS slot, coalesce(events, 0) AS events, coalesce(orders, 0) AS orders FROM a FULL JOIN b ON a.d = b.d AND a.h = b.h""")
def full_outer_daily(t):
    slot = lambda c, f: ((F.dayofweek(c) - 1) * 100 + f(c)).alias("slot")
    a = t.events.filter("event_type = 'error'").groupBy(slot("ts", F.hour)).agg(F.count("*").alias("events"))
    b = t.orders.groupBy(slot("o_orderdate", F.month)).agg(F.count("*").alias("orders"))
    return daily_outer(a, b, "slot", events=0, orders=0)


@query("""WITH w AS (SELECT DISTINCT lang AS name FROM documents) SELECT page_id, name, CAST((length(html) - length(replace(html, '/' || name || '/', ''))) / (length(name) + 2) AS INTEGER) AS hits FROM pages JOIN w ON contains(url, '/' || name || '/')""")
def name_containment(t):
    """Languages as a step of a page's URL, and how often that stands in the page; rows and names meet at rare pieces of the names."""
    names = t.documents.select("lang", F.concat(F.lit("/"), "lang", F.lit("/")).alias("step")).distinct()
    every = 2**31 - 1
    at = mentions(t.pages, names, "page_id", "url", "lang", "step", every).drop("hits")
    found = mentions(t.pages, names, "page_id", "html", "lang", "step", every)
    return at.join(found, ["page_id", "lang"], "left").select("page_id", F.col("lang").alias("name"), F.coalesce("hits", F.lit(0)).alias("hits"))


_PAIRS = """WITH pd AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), t AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM pd a JOIN pd b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2),
e AS (SELECT a AS src, b AS dst, n FROM t UNION ALL SELECT b, a, n FROM t) """


def supplier_pairs(t):
    """a, b, n: all pairs of suppliers that share orders, and how many."""
    return joins.counted_pairs(t.lineitem, "l_orderkey", "l_suppkey")


@query(_PAIRS + "SELECT src, count(*) AS degree, CAST(sum(n) AS BIGINT) AS weight FROM e GROUP BY 1")
def neighbours_bidirectional(t):
    return joins.undirected(supplier_pairs(t), "a", "b", "n").groupBy("src").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"))


@query(_PAIRS + """SELECT x.src, y.dst, count(DISTINCT x.dst) AS paths, min(x.dst) AS via FROM e x JOIN e y ON y.src = x.dst WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.src AND z.dst = y.dst) GROUP BY 1, 2""")
def two_hop_candidates(t):
    return joins.two_hop(joins.undirected(supplier_pairs(t)))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer""")
def scalar_subquery_cols(t):
    stats = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))
    return t.customer.join(stats, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "best")


@query("""WITH f AS (SELECT c_custkey AS entity, c_mktsegment AS value FROM customer), o AS (SELECT c_custkey + 5 AS entity, 'MANUAL' AS value FROM customer WHERE c_custkey % 100 = 3 UNION ALL SELECT -1, 'NEW')
SELECT coalesce(f.entity, o.entity) AS entity, coalesce(o.value, f.value) AS value, CASE WHEN o.value IS NOT NULL THEN f.value END AS overridden_attempt, CASE WHEN o.value IS NOT NULL THEN 'override' ELSE 'fact' END AS origin FROM f FULL JOIN o ON f.entity = o.entity""")
def override_overlay(t):
    facts = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("value"))
    manual = t.customer.filter("c_custkey % 100 = 3").select((F.col("c_custkey") + 5).alias("entity"), F.lit("MANUAL").alias("value"))
    extra = t.spark.range(1).select(F.lit(-1).cast("long").alias("entity"), F.lit("NEW").alias("value"))
    return joins.overlay(facts, manual.unionByName(extra), ["entity"], "value")


#: Cells of a text's profile: how often each occurs.
CELLS = (*"abcdefghijklmnopqrstuvwxyz", *"th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic".split())
_PROFILE = f"""WITH c AS (SELECT doc_id, list_transform({list(CELLS)}, lambda p: (length(text) - length(replace(text, p, ''))) / length(p)) AS c FROM documents WHERE text <> ''),
h AS (SELECT doc_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN c[i] * 64 > list_sum(c) THEN 1::UBIGINT << (64 - i) ELSE 0 END))::UBIGINT AS h FROM c),
g AS (SELECT h, min(doc_id) AS rep FROM h GROUP BY 1) """


def _profiles(batches):
    """(doc_id, text) -> (doc_id, h): a bit for each cell that has more than its part of the text's cells."""
    import pyarrow as pa

    cells = [c.encode() for c in CELLS]
    for batch in batches:
        hashes = []
        for text in batch.column("text").to_pylist():
            counts = [text.count(c) for c in cells]
            total, h = sum(counts), 0
            for n in counts:
                h = h << 1 | (n * len(cells) > total)
            hashes.append(h - (1 << 64) if h >> 63 else h)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashes, pa.int64())], ["doc_id", "h"])


@query(_PROFILE + """SELECT g.rep AS a, doc_id AS b, 0 AS distance FROM h JOIN g USING (h) WHERE doc_id <> g.rep
UNION ALL SELECT least(x.rep, y.rep), greatest(x.rep, y.rep), CAST(bit_count(xor(x.h, y.h)) AS INTEGER) FROM g x JOIN g y ON x.h >> 48 = y.h >> 48 AND x.rep < y.rep WHERE bit_count(xor(x.h, y.h)) <= 6""")
def hash_prefix_hamming(t):
    """Documents of equal profiles with their first one (distance 0), and first ones of like profiles with each other."""
    texts = t.documents.filter("text <> ''").select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = dict(t.documents.dtypes)["doc_id"]
    rows = staged(texts.mapInArrow(_profiles, f"doc_id {kind}, h long"), "profiles")
    return joins.near_hashes(rows, "doc_id", "h", 6)


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query, id, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, id) <= 5""")
def vector_topk(t):
    found = joins.vector_top_k(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), 5)
    return found.withColumn("cosine", F.round("cosine", 6))


@query("SELECT 'lineitem.part' AS reference, count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fk_audit(t):
    a = joins.orphans(t.lineitem, t.part.filter("p_size > 3"), "l_partkey", "p_partkey").agg(F.count("*").alias("orphans")).select(F.lit("lineitem.part").alias("reference"), "orphans")
    b = joins.orphans(t.orders, t.customer, "o_custkey", "c_custkey").agg(F.count("*").alias("orphans")).select(F.lit("orders.customer").alias("reference"), "orphans")
    return a.unionByName(b)


@query("""WITH r AS (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1),
p AS (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24' GROUP BY 1)
SELECT user_id, r.n AS recent_n, p.n AS prior_n, round(p.rate - r.rate, 6) AS lost FROM r JOIN p USING (user_id) WHERE r.n >= 5 AND p.n >= 5 AND p.rate - r.rate >= 0.1""")
def success_rate_drift(t):
    ok = F.avg((F.col("event_type") != "error").cast("double"))
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    recent = t.events.filter(F.col("ts") >= ntz("2024-01-24")).groupBy("user_id").agg(F.count("*").alias("recent_n"), ok.alias("a"))
    prior = t.events.filter((F.col("ts") >= ntz("2024-01-17")) & (F.col("ts") < ntz("2024-01-24"))).groupBy("user_id").agg(F.count("*").alias("prior_n"), ok.alias("b"))
    lost = F.col("b") - F.col("a")
    return recent.join(prior, "user_id").filter((F.col("recent_n") >= 5) & (F.col("prior_n") >= 5) & (lost >= 0.1)).select("user_id", "recent_n", "prior_n", F.round(lost, 6).alias("lost"))


@query("WITH s AS (SELECT l_suppkey, p_brand, sum(l_extendedprice) AS usd FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT l_suppkey, p_brand, round(usd, 2) AS usd FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY usd DESC, p_brand) <= 3")
def topn_per_group(t):
    sums = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.sum("l_extendedprice").alias("usd"))
    first = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("usd"), "p_brand"))
    return sums.withColumn("r", first).filter("r <= 3").select("l_suppkey", "p_brand", F.round("usd", 2).alias("usd"))


@query("WITH s AS (SELECT p_type, l_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT p_type, l_suppkey, round(v / sum(greatest(v, 0)) OVER (PARTITION BY p_type), 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY v DESC, l_suppkey) <= 5")
def share_of_total(t):
    from ..operators.aggregate import trailing_share

    sums = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    first = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("v"), "l_suppkey"))
    return trailing_share(sums, ["p_type"], "v").withColumn("r", first).filter("r <= 5").select("p_type", "l_suppkey", F.round("share", 6).alias("share"))


@query("""WITH c AS (SELECT p_type, list_sort(list(p_retailprice)) AS l, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN p_retailprice >= l[CAST(floor((n - 1) * 0.75) AS INTEGER) + 1] THEN 1 WHEN p_retailprice >= l[CAST(floor((n - 1) * 0.5) AS INTEGER) + 1] THEN 2 WHEN p_retailprice >= l[CAST(floor((n - 1) * 0.25) AS INTEGER) + 1] THEN 3 ELSE 4 END AS quartile FROM part JOIN c USING (p_type)""")
def cohort_quartile(t):
    from ..operators.aggregate import index_percentiles

    price = F.col("p_retailprice")
    cuts = index_percentiles(t.part, ["p_type"], "p_retailprice", {n: (q, "floor_nm1") for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))})
    return t.part.join(cuts, "p_type").select("p_partkey", F.when(price >= F.col("q3"), 1).when(price >= F.col("q2"), 2).when(price >= F.col("q1"), 3).otherwise(4).alias("quartile"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value / 10) * 100 + CASE event_type WHEN 'purchase' THEN 30 WHEN 'signup' THEN 20 ELSE 10 END DESC, ts DESC, event_id) = 1")
def best_fact(t):
    key = F.round(F.col("value") / 10) * 100 + F.when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "signup", 20).otherwise(10)
    return joins.latest_by(t.events, ["user_id"], key.desc(), F.desc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query("""SELECT kind, id, moment FROM (SELECT 'event' AS kind, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'order', o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders
UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') FROM lineitem) ORDER BY moment DESC, kind, id LIMIT 100""")
def merged_feed(t):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("moment")
    a = t.events.filter("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), at("ts"))
    b = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), at("o_orderdate"))
    c = t.lineitem.select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), at("l_shipdate"))
    return a.unionByName(b).unionByName(c).orderBy(F.desc("moment"), "kind", "id").limit(100)


@query("SELECT c_custkey, last FROM (SELECT c_custkey, CAST(max(o_orderdate)::DATE AS VARCHAR) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1) ORDER BY last NULLS FIRST, c_custkey LIMIT 50")
def stalest_first(t):
    last = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").cast("string").alias("last"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").orderBy(F.asc_nulls_first("last"), "c_custkey").limit(50)


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, length(html) AS priority FROM pages) SELECT page_id, host FROM h QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) <= 3""")
def frontier_pop(t):
    rows = t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.length("html").alias("priority"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "page_id"))
    return rows.withColumn("r", first).filter("r <= 3").select("page_id", "host")


@query("SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey % 3, s_name) = 1")
def cheapest_node(t):
    return t.supplier.filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("s_acctbal", F.col("s_suppkey") % 3, "s_name")).alias("s_suppkey"))


@query("SELECT kind, count(*) AS n FROM (SELECT event_type AS kind FROM events UNION ALL SELECT o_orderstatus FROM orders) GROUP BY 1")
def union_all(t):
    return t.events.select(F.col("event_type").alias("kind")).unionByName(t.orders.select(F.col("o_orderstatus").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).unionByName(t.nation.select(F.col("n_nationkey").alias("k"))).distinct()


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')
SELECT k, 'added' AS change FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'removed' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def list_delta(t):
    cut = lambda s: F.lit(s).cast("timestamp_ntz")
    a = t.lineitem.filter(F.col("l_shipdate") < cut("1996-01-01")).select(F.col("l_partkey").alias("k")).distinct()
    b = t.lineitem.filter(F.col("l_shipdate") >= cut("2001-01-01")).select(F.col("l_partkey").alias("k")).distinct()
    return b.join(a, "k", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "k", "left_anti").withColumn("change", F.lit("removed")))


@query("""WITH x AS (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [upper(string_split(p_name, ' ')[1]), p_type, lower(p_type)])) AS v, generate_subscripts(list_concat(string_split(p_name, ' '), [upper(string_split(p_name, ' ')[1]), p_type, lower(p_type)]), 1) AS i FROM part),
f AS (SELECT p_partkey, arg_min(v, i) AS v, min(i) AS i FROM x GROUP BY p_partkey, lower(v)) SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS merged FROM f GROUP BY 1""")
def ci_array_union(t):
    from ..functions.arrays import union_ignoring_case

    words = F.split("p_name", " ")
    more = F.array(F.upper(words[0]), F.col("p_type"), F.lower("p_type"))
    return t.part.select("p_partkey", F.array_join(union_ignoring_case(words, more), "|").alias("merged"))


@query("""WITH s AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1), p AS (SELECT s_suppkey, s_nationkey, m FROM supplier JOIN s ON l_suppkey = s_suppkey)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 6) AS jaccard FROM p a JOIN p b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE len(list_intersect(a.m, b.m)) > 0""")
def jaccard_sets(t):
    """Jaccard similarity of the parts that two suppliers of a nation deliver, where it is above 0."""
    sets = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", F.struct("s_nationkey", "l_partkey").alias("part"))
    return joins.set_similarities(sets, "s_suppkey", "part").select("a", "b", F.round("jaccard", 6).alias("jaccard"))
