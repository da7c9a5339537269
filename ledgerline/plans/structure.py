"""Graphs, funds, movements and ordered event data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import funds, graph, joins, sequences
from ..operators.aggregate import index_percentiles
from .registry import query
from .relational import _PAIRS, supplier_pairs


def _weighted(pairs):
    return pairs.select("a", "b", F.least(F.lit(1.0), F.col("n") / 10).alias("weight"))


def _rank_sql(edges: str, key: str = "") -> str:
    """30 rounds over edges (src, dst, weight and the key of their graph, if any); every node has an edge out."""
    g, on = (f"{key}, ", f" AND {{0}}.{key} = {{1}}.{key}") if key else ("", "")
    sizes = f"SELECT {g}count(DISTINCT src) AS n FROM w" + (f" GROUP BY {key}" if key else "")
    first = f", w AS ({edges}), o AS (SELECT {g}src, sum(weight) AS total FROM w GROUP BY {g}src), l AS (SELECT {'w.' + g if key else ''}w.src, dst, weight / total AS part FROM w JOIN o ON o.src = w.src{on.format('o', 'w')}), v AS ({sizes}), r0 AS (SELECT DISTINCT {'w.' + g if key else ''}src AS id, 1.0 / n AS rank FROM w JOIN v ON true{on.format('v', 'w')})"
    step = lambda i: f", r{i + 1} AS MATERIALIZED (SELECT {'l.' + g if key else ''}l.dst AS id, 0.15 / any_value(n) + 0.85 * sum(rank * part) AS rank FROM l JOIN r{i} ON r{i}.id = l.src{on.format(f'r{i}', 'l')} JOIN v ON true{on.format('v', 'l')} GROUP BY {'l.' + g if key else ''}l.dst)"
    return first + "".join(map(step, range(30))) + f" SELECT {g}id, round(rank, 6) AS rank FROM r30"


@query(_PAIRS + _rank_sql("SELECT src, dst, least(1.0, n / 10) AS weight FROM e"))
def pagerank(t):
    ranks = graph.pagerank(joins.undirected(_weighted(supplier_pairs(t)), "a", "b", "weight"))
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query(_PAIRS + _rank_sql("SELECT s_nationkey % 5 AS sector, src, dst, least(1.0, n / 10) AS weight FROM e JOIN supplier ON s_suppkey = src WHERE s_nationkey % 5 = (SELECT x.s_nationkey % 5 FROM supplier x WHERE x.s_suppkey = dst)", "sector"))
def sector_pagerank(t):
    nations = t.supplier.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") % 5).alias("sector"))
    other = nations.toDF("dst", "other")
    edges = joins.undirected(_weighted(supplier_pairs(t)), "a", "b", "weight").join(nations, "src").join(other, "dst").filter("sector = other").select("sector", "src", "dst", "weight")
    return graph.pagerank(edges, keys=("sector",)).select("sector", "id", F.round("rank", 6).alias("rank"))


@query(_PAIRS + """, b AS (SELECT src AS i, dst AS j, least(1.0, n / 10) AS w FROM e), t2 AS (SELECT i, sum(w) AS total, count(*) AS d FROM b GROUP BY 1), p AS (SELECT b.i, j, d, w / total AS p FROM b JOIN t2 USING (i)),
v AS (SELECT x.i, y.j, sum(x.p * y.p) AS q FROM p x JOIN p y ON y.i = x.j WHERE x.i <> y.j GROUP BY 1, 2)
SELECT p.i AS id, round(CASE WHEN max(d) >= 2 THEN 1 - least(1.0, sum(pow(p + coalesce(q, 0), 2))) ELSE 0 END, 6) AS broker FROM p LEFT JOIN v ON v.i = p.i AND v.j = p.j GROUP BY 1""")
def broker_score(t):
    return graph.constraint(_weighted(supplier_pairs(t))).select("id", F.round("broker", 6).alias("broker"))


@query(_PAIRS + ", d AS (SELECT src AS id, count(*) AS degree, round(sum(least(1.0, n / 10)), 4) AS strength FROM e GROUP BY 1) SELECT id, degree, strength FROM d QUALIFY row_number() OVER (PARTITION BY id % 5 ORDER BY degree DESC, strength DESC, id) <= 50")
def degrees_power(t):
    d = graph.degrees(_weighted(supplier_pairs(t))).withColumn("strength", F.round("strength", 4))
    first = F.row_number().over(Window.partitionBy(F.col("id") % 5).orderBy(F.desc("degree"), F.desc("strength"), "id"))
    return d.withColumn("r", first).filter("r <= 50").drop("r")


@query(_PAIRS + """, q AS (SELECT src, dst, n / (SELECT max(n) FROM e) AS quality FROM e), s AS (SELECT src, dst, 1 / (quality + 0.1) AS w FROM q QUALIFY row_number() OVER (PARTITION BY src ORDER BY quality DESC, dst) <= 200),
p1 AS (SELECT src, dst AS at1, [src, dst] AS path, w AS cost FROM s WHERE src % 50 = 0), p2 AS (SELECT p.src, s.dst AS at1, list_append(path, s.dst) AS path, cost + w AS cost FROM p1 p JOIN s ON s.src = p.at1 WHERE NOT list_contains(path, s.dst)),
p3 AS (SELECT p.src, s.dst AS at1, list_append(path, s.dst) AS path, cost + w AS cost FROM p2 p JOIN s ON s.src = p.at1 WHERE NOT list_contains(path, s.dst)), f AS (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)
SELECT src, at1 AS dst, array_to_string(path, '-') AS path, round(cost, 6) AS cost FROM f QUALIFY row_number() OVER (PARTITION BY src, at1 ORDER BY round(cost, 9), len(path), path) <= 5""")
def k_paths_3hop(t):
    sources = t.supplier.filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("id"))
    found = graph.best_paths(_qualities(supplier_pairs(t)), sources, F.lit(True), 3, 5, 200)
    return found.select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), F.round("cost", 6).alias("cost"))


def _qualities(pairs):
    """Both directions with quality: shared orders over the most that any pair shares."""
    most = pairs.agg(F.max("n").alias("most"))  # one row
    return joins.undirected(pairs, "a", "b", "n").crossJoin(F.broadcast(most)).select("src", "dst", (F.col("n") / F.col("most")).alias("quality"))


@query(_PAIRS + """, q AS (SELECT src, dst, n / (SELECT max(n) FROM e) AS quality FROM e),
p1 AS (SELECT src, dst AS at1, [src, dst] AS path, quality AS total FROM q WHERE src % 50 = 0), p2 AS (SELECT p.src, q.dst AS at1, list_append(path, q.dst) AS path, total + quality AS total FROM p1 p JOIN q ON q.src = p.at1 WHERE NOT list_contains(path, q.dst)),
p3 AS (SELECT p.src, q.dst AS at1, list_append(path, q.dst) AS path, total + quality AS total FROM p2 p JOIN q ON q.src = p.at1 WHERE NOT list_contains(path, q.dst)),
d AS (SELECT src, at1, min(len(path)) AS hops FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) GROUP BY 1, 2), f AS (SELECT x.* FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) x JOIN d ON d.src = x.src AND d.at1 = x.at1 AND len(path) = hops)
SELECT src, at1 AS dst, len(path) - 1 AS hops, array_to_string(path, '-') AS path, round(total, 6) AS quality FROM f QUALIFY row_number() OVER (PARTITION BY src, at1 ORDER BY round(total, 9) DESC, path) <= 5""")
def bfs_4hop(t):
    """The five best of the shortest paths, of at most 4 hops, from every fiftieth supplier to all others."""
    sources = t.supplier.filter("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("id"))
    found = graph.shortest_paths(_qualities(supplier_pairs(t)), sources, 4, 5)
    return found.select("src", "dst", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), F.round("quality", 6).alias("quality"))


@query(_PAIRS + """, r1 AS (SELECT DISTINCT src, dst AS id FROM e), r2 AS (SELECT DISTINCT r1.src, e.dst AS id FROM r1 JOIN e ON e.src = r1.id WHERE e.dst <> r1.src),
r3 AS (SELECT DISTINCT r2.src, e.dst AS id FROM r2 JOIN e ON e.src = r2.id WHERE e.dst <> r2.src), u AS (SELECT s_suppkey AS src, s_suppkey AS id, 0 AS d FROM supplier UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)
SELECT src, id, min(d) AS distance FROM u GROUP BY 1, 2""")
def neighbourhood_3hop(t):
    """All suppliers within three hops of each supplier."""
    sources = t.supplier.select(F.col("s_suppkey").alias("id"))
    return graph.distances(joins.undirected(supplier_pairs(t)), sources, 3)


@query("SELECT c_custkey, round(1 / (1 + exp(-(-1.0 + 0.0002 * c_acctbal + 0.05 * c_nationkey))), 6) AS p FROM customer")
def intro_predict(t):
    return t.customer.select("c_custkey", F.round(graph.sigmoid(-1.0 + 0.0002 * F.col("c_acctbal") + 0.05 * F.col("c_nationkey")), 6).alias("p"))


@query("""WITH RECURSIVE r AS (SELECT o_totalprice / 500000 AS x, CAST(left(o_orderpriority, 1) AS DOUBLE) / 5 AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders),
w AS (SELECT 0 AS epoch, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2 UNION ALL
SELECT epoch + 1, w0 - 0.1 * avg(1 / (1 + exp(-(w0 + w1 * x + w2 * p))) - y), w1 - 0.1 * (avg((1 / (1 + exp(-(w0 + w1 * x + w2 * p))) - y) * x) + 0.01 * w1), w2 - 0.1 * (avg((1 / (1 + exp(-(w0 + w1 * x + w2 * p))) - y) * p) + 0.01 * w2) FROM w, r WHERE epoch < 200 GROUP BY epoch, w0, w1, w2)
SELECT position, round(CASE position WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END, 4) AS weight FROM w, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS position) WHERE epoch = 200""")
def intro_train(t):
    rows = t.orders.select((F.col("o_totalprice") / 500000).alias("x"), (F.substring("o_orderpriority", 1, 1).cast("double") / 5).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    weights = graph.fit_logistic(rows, ["x", "p"], "y")
    return t.spark.createDataFrame([(i, round(w, 4)) for i, w in enumerate(weights or [])], "position int, weight double")


@query("""WITH f AS (SELECT l_suppkey AS fund, sum(l_extendedprice) * 1.5 AS committed, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS called, sum(l_extendedprice) / 80 AS pace, 36 - count(*) % 24 AS months FROM lineitem GROUP BY 1)
SELECT fund, round(0.8 * least(greatest(committed - called, 0), pace * months), 2) AS low, round(least(greatest(committed - called, 0), pace * months), 2) AS mid, round(least(greatest(committed - called, 0), 1.2 * least(greatest(committed - called, 0), pace * months)), 2) AS high FROM f""")
def dry_powder(t):
    total = F.sum("l_extendedprice")
    f = t.lineitem.groupBy(F.col("l_suppkey").alias("fund")).agg((total * 1.5).alias("committed"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("called"), (total / 80).alias("pace"), (36 - F.count("*") % 24).alias("months"))
    band = f.select("fund", *funds.dry_powder(F.col("committed"), F.col("called"), F.col("pace"), F.col("months")))
    return band.select("fund", *(F.round(c, 2).alias(c) for c in ("low", "mid", "high")))


_EXIT = """WITH x AS (SELECT l_suppkey AS fund, l_orderkey, l_linenumber, l_extendedprice AS position, l_discount AS own, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'ipo' ELSE 'acquisition' END WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN 'bankruptcy' ELSE 'held' END ELSE 'held' END AS kind,
o_totalprice * 8 AS price, l_tax * 10 AS escrow, CASE WHEN l_linenumber % 2 = 0 THEN o_totalprice * 5 END AS mark, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, CASE kind WHEN 'ipo' THEN price * own WHEN 'acquisition' THEN price * own * (1 - least(0.5, greatest(0, escrow))) WHEN 'bankruptcy' THEN 0 ELSE coalesce(mark * own, position) END AS proceeds FROM x) """


def _exits(t):
    kind = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "ipo").otherwise("acquisition")).when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "bankruptcy").otherwise("held")
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("kind", kind)
    mark = F.when(F.col("l_linenumber") % 2 == 0, F.col("o_totalprice") * 5)
    return joined.withColumn("proceeds", funds.exit_proceeds(F.col("kind"), F.col("l_extendedprice"), F.col("l_discount"), F.col("o_totalprice") * 8, F.col("l_tax") * 10, mark))


@query(_EXIT + "SELECT fund, kind, count(*) AS n, round(sum(proceeds), 2) AS proceeds FROM r GROUP BY 1, 2")
def exit_proceeds(t):
    return _exits(t).groupBy(F.col("l_suppkey").alias("fund"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("proceeds"), 2).alias("proceeds"))


@query(_EXIT + """, f AS (SELECT fund, sum(position) AS paid, sum(CASE WHEN kind IN ('ipo', 'acquisition') THEN proceeds ELSE 0 END) AS d, sum(CASE WHEN kind = 'held' THEN proceeds ELSE 0 END) AS v, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2001-12-31') / 365.25 AS y FROM r GROUP BY 1)
SELECT fund, round(d / paid, 6) AS dpi, round(v / paid, 6) AS rvpi, round((d + v) / paid, 6) AS tvpi, round(pow((d + v) / paid, 1 / y) - 1, 6) AS annualised FROM f""")
def fund_returns(t):
    gone, held = F.col("kind").isin("ipo", "acquisition"), F.col("kind") == "held"
    years = F.datediff(F.lit("2001-12-31").cast("date"), F.min("o_orderdate").cast("date")) / 365.25
    f = _exits(t).groupBy(F.col("l_suppkey").alias("fund")).agg(F.sum("l_extendedprice").alias("paid"), F.sum(F.when(gone, F.col("proceeds")).otherwise(0.0)).alias("d"), F.sum(F.when(held, F.col("proceeds")).otherwise(0.0)).alias("v"), years.alias("y"))
    m = f.select("fund", *funds.multiples(F.col("paid"), F.col("d"), F.col("v"), F.col("y")))
    return m.select("fund", *(F.round(c, 6).alias(c) for c in ("dpi", "rvpi", "tvpi", "annualised")))


@query("""WITH r AS (SELECT p_type, p_size % 7 AS size, l_extendedprice AS actual, p_retailprice * l_quantity AS predicted FROM lineitem JOIN part ON p_partkey = l_partkey), b AS (SELECT p_type, size, median(actual / predicted) AS m, count(*) AS n FROM r WHERE predicted <> 0 GROUP BY 1, 2)
SELECT p_type, size, round(CASE WHEN n >= 3 THEN least(1.5, greatest(0.5, m)) ELSE 1 END, 6) AS bias, n FROM b""")
def bias_calibration(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_type", (F.col("p_size") % 7).alias("size"), F.col("l_extendedprice").alias("actual"), (F.col("p_retailprice") * F.col("l_quantity")).alias("predicted"))
    return funds.bias(rows, ["p_type", "size"], "predicted", "actual").withColumn("bias", F.round("bias", 6))


@query("""WITH q AS (SELECT p_brand, p_type, count(*) AS peers, list_sort(list(p_retailprice / p_size))[CAST(least(count(*) - 1, floor(count(*) * 0.5)) AS INTEGER) + 1] AS multiple FROM part GROUP BY 1, 2)
SELECT p_partkey, round(CASE WHEN peers >= 3 THEN p_size * multiple WHEN p_size % 2 = 0 THEN p_retailprice END, 4) AS value, CASE WHEN peers >= 3 THEN 'peers' WHEN p_size % 2 = 0 THEN 'mark' ELSE 'none' END AS method FROM part JOIN q USING (p_brand, p_type)""")
def implied_valuation(t):
    panel = index_percentiles(t.part.withColumn("m", F.col("p_retailprice") / F.col("p_size")), ["p_brand", "p_type"], "m", {"multiple": (0.5, "floor_n")}).withColumnRenamed("n", "peers")
    value, method = funds.implied_value(F.col("p_size"), F.col("peers"), F.col("multiple"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")))
    return t.part.join(panel, ["p_brand", "p_type"]).select("p_partkey", F.round(value, 4).alias("value"), method.alias("method"))


@query("""SELECT p_type, p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part WHERE p_size BETWEEN 5 AND 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) GROUP BY 1, 2 HAVING count(*) >= 2""")
def comp_panel(t):
    excluded = t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    screened = t.part.filter("p_size between 5 and 40").join(excluded, "p_partkey", "left_anti")
    return screened.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")).filter("n >= 2")


_SNAPSHOTS = """WITH h AS (SELECT o_custkey % 20 AS company, year(o_orderdate) AS at1, o_orderpriority AS holder, count(*) / 10.0 AS share FROM orders WHERE o_custkey % 3 <> 0 OR o_orderpriority <> '1-URGENT' OR year(o_orderdate) % 2 = 0 GROUP BY 1, 2, 3), """


@query(_SNAPSHOTS + """n AS (SELECT company, at1, row_number() OVER (PARTITION BY company ORDER BY at1) AS i FROM (SELECT DISTINCT company, at1 FROM h)), r AS (SELECT h.company, i, holder, share FROM h JOIN n USING (company, at1)),
j AS (SELECT coalesce(a.company, b.company) AS company, coalesce(a.i, b.i + 1) AS i, coalesce(a.holder, b.holder) AS holder, coalesce(b.share, 0) AS before, coalesce(a.share, 0) AS after FROM r a FULL JOIN r b ON a.company = b.company AND a.i = b.i + 1 AND a.holder = b.holder)
SELECT j.company, n.at1 AS year, holder, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CASE WHEN before = 0 THEN 'entered' WHEN after = 0 THEN 'exited' WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'same' END AS step FROM j JOIN n ON n.company = j.company AND n.i = j.i WHERE j.i > 1""")
def snapshot_waterfall(t):
    kept = t.orders.filter((F.col("o_custkey") % 3 != 0) | (F.col("o_orderpriority") != "1-URGENT") | (F.year("o_orderdate") % 2 == 0))
    h = kept.groupBy((F.col("o_custkey") % 20).alias("company"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("holder")).agg((F.count("*") / 10.0).alias("share"))
    return funds.snapshot_steps(h, ["company"], "year", "holder", "share")


@query("""WITH m AS (SELECT DISTINCT o_custkey % 40 AS firm, year(o_orderdate) AS period, o_custkey AS member FROM orders), p AS (SELECT DISTINCT firm, period FROM m), f AS (SELECT * FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.firm = a.firm AND b.period + 1 = a.period))
SELECT m.firm, m.period, member, 'joined' AS change FROM m JOIN f USING (firm, period) WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.firm = m.firm AND x.member = m.member AND x.period IN (m.period - 1, m.period - 2))
UNION ALL SELECT m.firm, m.period + 1, member, 'left' FROM m JOIN f ON f.firm = m.firm AND f.period = m.period + 1 WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.firm = m.firm AND x.member = m.member AND x.period IN (m.period + 1, m.period + 2))""")
def team_diff(t):
    m = t.orders.select((F.col("o_custkey") % 40).alias("firm"), F.year("o_orderdate").alias("period"), F.col("o_custkey").alias("member"))
    return funds.member_changes(m, ["firm"], "period", "member", 1)


@query("""WITH c AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS m, list(DISTINCT p_brand) AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
w AS (SELECT l_suppkey, m, list_distinct(flatten(list(c) OVER (PARTITION BY l_suppkey ORDER BY m RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))) AS a, coalesce(list_distinct(flatten(list(c) OVER (PARTITION BY l_suppkey ORDER BY m RANGE BETWEEN 11 PRECEDING AND 6 PRECEDING))), []) AS b FROM c)
SELECT l_suppkey, m AS month, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS drift FROM w""")
def strategy_drift(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"), "p_brand")
    return funds.rolling_drift(rows, ["l_suppkey"], "month", "p_brand").withColumn("drift", F.round("drift", 6))


@query("""SELECT o_orderkey, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND INTERVAL 90 DAY FOLLOWING) QUALIFY n >= 3""")
def anchored_clusters(t):
    return funds.clusters(t.orders, ["o_custkey"], "o_orderdate", 90, 3).select("o_orderkey", "n")


@query("""WITH i AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS deals, avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0 END) AS lead, count(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY 1)
SELECT l_suppkey, deals, CASE WHEN deals >= 620 AND lead >= 0.25 THEN 'super' WHEN lead >= 0.24 THEN 'lead' WHEN years >= 6 THEN 'active' ELSE 'follower' END AS class FROM i""")
def angel_class(t):
    i = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("deals"), F.avg((F.col("l_linenumber") == 1).cast("double")).alias("lead"), F.countDistinct(F.year("l_shipdate")).alias("years"))
    found = F.when((F.col("deals") >= 620) & (F.col("lead") >= 0.25), "super").when(F.col("lead") >= 0.24, "lead").when(F.col("years") >= 6, "active").otherwise("follower")
    return i.select("l_suppkey", "deals", found.alias("class"))


@query(_PAIRS + ", c AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS deals FROM lineitem GROUP BY 1) SELECT a, b, n, round(n / least(x.deals, y.deals), 6) AS overlap FROM t JOIN c x ON x.l_suppkey = a JOIN c y ON y.l_suppkey = b")
def syndicate_overlap(t):
    deals = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("deals"))
    joined = supplier_pairs(t).join(deals.toDF("a", "da"), "a").join(deals.toDF("b", "db"), "b")
    return joined.select("a", "b", "n", F.round(F.col("n") / F.least("da", "db"), 6).alias("overlap"))


@query("SELECT user_id, round(sum(value) / 3600.0 * 0.5 + sum(CAST(json_extract(props, '$.k') AS INTEGER)) / 1000.0 * 0.02, 6) AS cost FROM events GROUP BY 1")
def compute_cost(t):
    units = F.get_json_object("props", "$.k").cast("int")
    return t.events.groupBy("user_id").agg(F.round(F.sum("value") / 3600.0 * 0.5 + F.sum(units) / 1000.0 * 0.02, 6).alias("cost"))


_LAGS = "WITH l AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "


@query(_LAGS + "SELECT event_id, before IS NULL OR (epoch_us(ts) - epoch_us(before)) / 1e6 >= 3600 AS emitted FROM l")
def dedupe_window(t):
    return sequences.suppress_repeats(t.events, ["user_id"], "ts", "event_id", 3600).select("event_id", "emitted")


@query(_LAGS + "SELECT event_id, kind_before AS before, event_type FROM l WHERE kind_before IS NOT NULL AND NOT ((kind_before, event_type) IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'view'), ('view', 'view')))")
def fsm_violations(t):
    legal = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "view")]
    return sequences.illegal_transitions(t.events, ["user_id"], ["ts", "event_id"], "event_type", legal).select("event_id", "before", "event_type")


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events), a AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt FROM r WHERE event_type = 'error')
SELECT event_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt < 3 THEN 'retry' ELSE 'dead' END AS state, CASE WHEN attempt < 3 THEN strftime(ts + to_seconds(CAST(30 * pow(2, attempt) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS due FROM a""")
def retry_schedule(t):
    found = sequences.retries(t.events, ["user_id"], "ts", "event_id", F.col("event_type") == "error")
    return found.select("event_id", "attempt", "state", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("""WITH f AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS failures FROM events) SELECT event_id, failures, CASE WHEN failures >= 5 THEN 'dead_letter' ELSE 'live' END AS state FROM f""")
def job_dead_letters(t):
    return sequences.dead_letters(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures", "state")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def rate_limit(t):
    return sequences.fixed_window_limit(t.events, ["user_id"], "ts", "1 day", 2, "event_id").select("event_id", "allowed")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), b AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 AS gap FROM n WHERE event_type = 'error'),
o AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS incident FROM b)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_bad, count(*) AS n_bad FROM o GROUP BY user_id, incident""")
def incident_islands(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    found = sequences.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2)
    return found.select("user_id", text("opened"), text("last_bad"), "n_bad")


@query(_LAGS + """, s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sequences.sessions(t.events, ["user_id"], "ts", "2 hours").select("user_id", text("started"), text("ended"), "n")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS moment, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 'start' AS state, []::BIGINT[] AS recent, NULL::BIGINT AS until FROM events GROUP BY 1 UNION ALL
SELECT o.user_id, o.i, o.event_id, CASE WHEN moment < until THEN 'open' ELSE 'closed' END,
CASE WHEN moment < until THEN recent WHEN NOT failed THEN [] WHEN len(list_filter(recent, lambda x: moment - x <= 86400000000)) + 1 >= 2 THEN [] ELSE list_append(list_filter(recent, lambda x: moment - x <= 86400000000), moment) END,
CASE WHEN moment < until THEN until WHEN failed AND len(list_filter(recent, lambda x: moment - x <= 86400000000)) + 1 >= 2 THEN moment + 43200000000 ELSE until END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT event_id, state FROM s WHERE i > 0""")
def circuit_breaker(t):
    rows = t.events.withColumn("failed", F.col("event_type") == "error")
    return sequences.breaker(rows, ["user_id"], "ts", "event_id", "failed", 2, 86400, 43200).select("event_id", "state")


@query("""WITH x AS (SELECT o_custkey, o_orderdate, o_orderkey, unnest([{'f': 'status', 'a': o_orderstatus, 'b': lag(o_orderstatus) OVER w}, {'f': 'priority', 'a': o_orderpriority, 'b': lag(o_orderpriority) OVER w}]) AS e, row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE e.f WHEN 'status' THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS field, e.b AS before, e.a AS after FROM x WHERE i > 1 AND e.a <> e.b""")
def field_diff(t):
    return sequences.field_changes(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "field", "before", "after")


@query("""SELECT strftime(CASE event_type WHEN 'error' THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 'purchase' THEN date_trunc('day', ts) + INTERVAL 1 DAY ELSE date_trunc('week', ts) + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M') AS due, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def digest_bucket(t):
    due = F.when(F.col("event_type") == "error", F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).when(F.col("event_type") == "purchase", F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.date_trunc("week", "ts") + F.expr("INTERVAL 7 DAY"))
    return t.events.groupBy(F.date_format(due, "yyyy-MM-dd HH:mm").alias("due"), "event_type").agg(F.count("*").alias("n"))
