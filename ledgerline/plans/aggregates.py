"""Counting, series, histograms, percentiles and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, ratio, saturate
from ..operators import aggregate as agg
from ..operators.aggregate import index_percentiles
from .registry import query

EVENTS_AS_OF = "2024-01-31"


@query("""SELECT c_mktsegment AS sector, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS deal_count, round(sum(o_totalprice), 2) AS total_usd
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def sector_momentum(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("sector"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("deal_count"), F.round(F.sum("o_totalprice"), 2).alias("total_usd"))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open,
count(*) FILTER (o_totalprice > 250000) AS large, count(DISTINCT o_custkey) AS customers FROM orders""")
def kpi_counts(t):
    return t.orders.agg(F.count("*").alias("total"), *agg.count_where(finished=F.col("o_orderstatus") == "F", open=F.col("o_orderstatus") == "O", large=F.col("o_totalprice") > 250000), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1")
def counts_by_category(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source NULLS LAST LIMIT 10")
def top_sources(t):
    return agg.top_values(t.documents, "source", 10)


@query("""WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM d LEFT JOIN c USING (day)""")
def daily_counts_gapfilled(t):
    counts = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return agg.fill_days(counts, "day", "2023-12-30", "2024-02-02", n=0, errors=0).withColumn("day", F.col("day").cast("string"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS tier, count(*) AS n, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS heavy
FROM events GROUP BY 1, 2""")
def hourly_tier_mix(t):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.col("event_type").alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 4).alias("heavy"))


@query("""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def minute_throughput(t):
    return t.events.groupBy(F.window("ts", "5 minutes")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "n", "users")


@query("SELECT strftime(o_orderdate, '%Y-W%W') AS week, count(*) AS n FROM orders GROUP BY 1")
def weekly_timeline(t):
    week = F.concat(F.year("o_orderdate"), F.lit("-W"), F.lpad(agg.week_of_year(F.col("o_orderdate")).cast("string"), 2, "0"))
    return t.orders.groupBy(week.alias("week")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def status_pivot_by_day(t):
    kinds = ["click", "error", "purchase", "signup", "view"]
    pivoted = t.events.groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return pivoted.fillna(0, kinds)


@query("""WITH c AS (SELECT event_type AS tier, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT DISTINCT event_type AS tier, unnest(range(24)) AS h FROM events)
SELECT s.tier, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY s.h) AS slots FROM s LEFT JOIN c USING (tier, h) GROUP BY 1""")
def sparkline_24(t):
    counts = t.events.groupBy(F.col("event_type").alias("tier"), F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    dense = counts.groupBy("tier").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("by_hour"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("by_hour", h), F.lit(0)).cast("string"))
    return dense.select("tier", F.array_join(slots, ",").alias("slots"))


@query("""WITH r AS (SELECT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT n_name FROM r GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 12), b AS (SELECT c_mktsegment FROM r GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 12)
SELECT n_name, c_mktsegment, count(*) AS n FROM r WHERE n_name IN (FROM a) AND c_mktsegment IN (FROM b) GROUP BY 1, 2""")
def segment_matrix_top12(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.matrix(rows, "n_name", "c_mktsegment", 12)


@query("""SELECT o_orderpriority AS stage, c_mktsegment AS sector, count(*) AS n, round(sum(o_totalprice), 2) AS usd
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def stage_sector_heatmap(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("stage"), F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("usd"))


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT CAST(least(19, floor((o_totalprice - lo) / ((hi - lo) / 20))) AS INTEGER) AS bucket, lo, hi, count(*) AS n FROM orders, b GROUP BY ALL)
SELECT bucket, round(lo + bucket * ((hi - lo) / 20), 4) AS low, round(lo + (bucket + 1) * ((hi - lo) / 20), 4) AS high, n FROM c""")
def histogram_equiwidth(t):
    return agg.equi_width(t.orders, "o_totalprice", 20).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("""SELECT CASE WHEN c_acctbal < 2500 THEN '0-25' WHEN c_acctbal < 5000 THEN '25-50' WHEN c_acctbal < 7500 THEN '50-75' ELSE '75-100' END AS band, count(*) AS n FROM customer GROUP BY 1""")
def score_buckets(t):
    b = F.col("c_acctbal")
    band = F.when(b < 2500, "0-25").when(b < 5000, "25-50").when(b < 7500, "50-75").otherwise("75-100")
    return t.customer.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT 0 AS position, 'all' AS stage, count(*) AS n FROM orders UNION ALL SELECT 1, 'priced', count(*) FILTER (o_totalprice > 100000) FROM orders
UNION ALL SELECT 2, 'urgent', count(*) FILTER (o_totalprice > 100000 AND o_orderpriority <= '2') FROM orders
UNION ALL SELECT 3, 'closed', count(*) FILTER (o_totalprice > 100000 AND o_orderpriority <= '2' AND o_orderstatus = 'F') FROM orders""")
def funnel_stages(t):
    priced = F.col("o_totalprice") > 100000
    urgent = priced & (F.col("o_orderpriority") <= "2")
    return agg.funnel(t.orders, {"all": F.lit(True), "priced": priced, "urgent": urgent, "closed": urgent & (F.col("o_orderstatus") == "F")})


@query("""SELECT o_orderstatus AS status, round(sum(coalesce(o_totalprice, 0)), 2) AS usd, round(sum(coalesce(o_totalprice, 0)) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY 1""")
def value_by_status(t):
    summed = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.sum(F.coalesce("o_totalprice", F.lit(0.0))).alias("v"))
    everything = F.sum("v").over(Window.partitionBy(F.lit(1)))
    return summed.select("status", F.round("v", 2).alias("usd"), F.round(F.col("v") / everything, 6).alias("share"))


@query("""WITH s AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(n // 10 AS BIGINT) AS size, round(avg(s), 3) AS mean_seconds, count(*) AS users FROM s GROUP BY 1""")
def avg_duration_seconds(t):
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    spans = t.events.groupBy("user_id").agg((span / 1e6).alias("s"), F.count("*").alias("n"))
    return spans.groupBy(F.floor(F.col("n") / 10).alias("size")).agg(F.round(F.avg("s"), 3).alias("mean_seconds"), F.count("*").alias("users"))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_counts(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM lineitem GROUP BY 1")
def group_concat_members(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("members"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1 HAVING count(*) >= 5 AND avg(value) < 50")
def having_avg_low(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m")).filter("n >= 5 and m < 50").select("user_id", "n", F.round("m", 4).alias("mean"))


@query("SELECT c_custkey, c_name, count(*) AS deals FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING deals > 12")
def having_alias(t):
    # The name depends on the key, so it need not be one.
    joined = t.orders.groupBy("o_custkey").agg(F.count("*").alias("deals")).filter("deals > 12")
    return joined.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "deals")


@query("SELECT p_brand, round(median(p_retailprice), 4) AS median FROM part GROUP BY 1")
def median_true(t):
    return t.part.groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 4).alias("median"))


@query("SELECT p_brand, list_sort(list(p_retailprice))[CAST(floor(count(*) / 2.0) AS INTEGER) + 1] AS median FROM part GROUP BY 1")
def median_upper(t):
    return index_percentiles(t.part, ["p_brand"], "p_retailprice", {"median": (0.5, "upper_median")}).drop("n")


@query("SELECT p_type, list_sort(list(p_retailprice))[CAST(floor((count(*) - 1) * 0.75) AS INTEGER) + 1] AS p75 FROM part GROUP BY 1")
def pct_floor_nm1(t):
    return index_percentiles(t.part, ["p_type"], "p_retailprice", {"p75": (0.75, "floor_nm1")}).drop("n")


@query("SELECT p_type, list_sort(list(p_retailprice))[CAST(least(count(*) - 1, floor(count(*) * 0.9)) AS INTEGER) + 1] AS p90 FROM part GROUP BY 1")
def pct_floor_n(t):
    return index_percentiles(t.part, ["p_type"], "p_retailprice", {"p90": (0.9, "floor_n")}).drop("n")


@query("""WITH s AS (SELECT year(o_orderdate) AS vintage, o_orderpriority AS strategy, list_sort(list(o_totalprice)) AS l, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT vintage, strategy, n, l[1] AS p0, l[CAST(least(n - 1, floor(n * 0.25)) AS INTEGER) + 1] AS p25, l[CAST(least(n - 1, floor(n * 0.5)) AS INTEGER) + 1] AS p50,
l[CAST(least(n - 1, floor(n * 0.75)) AS INTEGER) + 1] AS p75, l[n] AS p100 FROM s""")
def five_number(t):
    rows = t.orders.select(F.year("o_orderdate").alias("vintage"), F.col("o_orderpriority").alias("strategy"), "o_totalprice")
    return index_percentiles(rows, ["vintage", "strategy"], "o_totalprice", {f"p{round(100 * q)}": (q, "floor_n") for q in (0.0, 0.25, 0.5, 0.75, 1.0)})


@query("""SELECT c_custkey, round((rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1) / count(*) OVER (PARTITION BY c_nationkey), 6) AS below FROM customer""")
def share_below_percentile(t):
    by_nation = Window.partitionBy("c_nationkey")
    below = (F.rank().over(by_nation.orderBy("c_acctbal")) - 1) / F.count("*").over(by_nation)
    return t.customer.select("c_custkey", F.round(below, 6).alias("below"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderdate) AS f FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f, o_orderpriority DESC) = 1""")
def modal_category(t):
    counted = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("f"))
    first = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "f", F.desc("o_orderpriority"))
    return counted.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("o_custkey", "o_orderpriority", "n")


@query("""SELECT p_type, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 4) AS returned,
round(sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 4) AS returned_finished, count(*) FILTER (l_returnflag = 'R') >= 5 AS enough
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def term_benchmark_shares(t):
    returned = F.col("l_returnflag") == "R"
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.avg(returned.cast("double")), 4).alias("returned"), F.round(F.avg(F.when(returned, (F.col("l_linestatus") == "F").cast("double"))), 4).alias("returned_finished"), (F.count_if(returned) >= 5).alias("enough"))


@query("""SELECT l_suppkey, round(sum(l_discount * CASE WHEN l_linenumber = 1 THEN 1.5 ELSE 1 END) / sum(CASE WHEN l_linenumber = 1 THEN 1.5 ELSE 1 END), 6) AS discount,
round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1""")
def weighted_mean_lead(t):
    weight = F.when(F.col("l_linenumber") == 1, 1.5).otherwise(1.0)
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * weight) / F.sum(weight), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))


@query("""WITH s AS (SELECT user_id, CAST(1 + (CAST(json_extract(props, '$.k') AS INTEGER) % 5) AS INTEGER) AS stars FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(100.0 * (count(*) FILTER (stars >= 4) - count(*) FILTER (stars <= 2)) / count(*), 4) END AS nps,
CASE WHEN count(*) >= 5 THEN round((100.0 * (count(*) FILTER (stars >= 4) - count(*) FILTER (stars <= 2)) / count(*) + 100) / 200, 6) END AS board FROM s GROUP BY 1""")
def nps_min_sample(t):
    stars = 1 + F.get_json_object("props", "$.k").cast("int") % 5
    scored = t.events.filter("event_type = 'purchase'").select("user_id", stars.alias("stars"))
    nps = 100.0 * (F.count_if(F.col("stars") >= 4) - F.count_if(F.col("stars") <= 2)) / F.count("*")
    grouped = scored.groupBy("user_id").agg(F.count("*").alias("n"), nps.alias("v"))
    public = agg.minimum_sample(F.col("v"), F.col("n"), 5)
    return grouped.select("user_id", "n", F.round(public, 4).alias("nps"), F.round((public + 100) / 200, 6).alias("board"))


@query("""WITH m AS (SELECT o_orderpriority AS round, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS usd FROM orders GROUP BY 1, 2),
r AS (SELECT round, usd / lag(usd) OVER w AS ratio, usd - lag(usd) OVER w AS delta FROM m WINDOW w AS (PARTITION BY round ORDER BY month))
SELECT round, round(exp(avg(ln(ratio))), 6) AS growth, round(avg(delta), 2) AS mean_delta FROM r GROUP BY 1""")
def geo_mean_growth(t):
    monthly = t.orders.groupBy(F.col("o_orderpriority").alias("round"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("usd"))
    before = F.lag("usd").over(Window.partitionBy("round").orderBy("month"))
    steps = monthly.select("round", (F.col("usd") / before).alias("ratio"), (F.col("usd") - before).alias("delta"))
    return steps.groupBy("round").agg(F.round(F.exp(F.avg(F.ln("ratio"))), 6).alias("growth"), F.round(F.avg("delta"), 2).alias("mean_delta"))


#: Weights of signal kinds, and the half-life in days of their decay.
SIGNAL_WEIGHTS = {"purchase": 10.0, "signup": 6.0, "click": 2.0, "view": 1.0}
SIGNAL_HALF_LIFE = 30.0


def _decayed(t):
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in SIGNAL_WEIGHTS.items() for x in kv)), F.col("event_type"))
    days = (F.unix_micros(F.to_timestamp(F.lit(EVENTS_AS_OF))) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    return t.events.filter(F.col("event_type").isin(*SIGNAL_WEIGHTS)).select("user_id", "event_type", (weight * F.pow(F.lit(0.5), days / SIGNAL_HALF_LIFE)).alias("s"))


_DECAYED_SQL = """WITH s AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 10.0 WHEN 'signup' THEN 6.0 WHEN 'click' THEN 2.0 ELSE 1.0 END
* pow(0.5, ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400e6) / 30.0) AS s FROM events WHERE event_type <> 'error') """


@query(_DECAYED_SQL + "SELECT user_id, round(100 * (1 - exp(-sum(s) / 25.0)), 3) AS intent, count(*) AS n FROM s GROUP BY 1")
def intent_score(t):
    return _decayed(t).groupBy("user_id").agg(F.round(saturate(F.sum("s"), 25), 3).alias("intent"), F.count("*").alias("n"))


@query(_DECAYED_SQL + "SELECT user_id, event_type AS kind, round(sum(s), 4) AS points FROM s GROUP BY 1, 2")
def intent_breakdown(t):
    return _decayed(t).groupBy("user_id", F.col("event_type").alias("kind")).agg(F.round(F.sum("s"), 4).alias("points"))


@query("""WITH c AS (SELECT user_id, event_type, sum(value * CASE WHEN event_type = 'error' THEN 2.0 ELSE 0.5 END) AS a FROM events GROUP BY 1, 2),
s AS (SELECT user_id, sum(least(a, CASE event_type WHEN 'error' THEN 400.0 WHEN 'purchase' THEN 100.0 ELSE 50.0 END)) AS score FROM c GROUP BY 1)
SELECT user_id, round(score, 4) AS score, CASE WHEN score >= 500 THEN 'high' WHEN score >= 300 THEN 'medium' ELSE 'low' END AS band FROM s""")
def risk_score_capped(t):
    severity = F.when(F.col("event_type") == "error", 2.0).otherwise(0.5)
    scored = agg.capped_sums(t.events, "user_id", "event_type", F.col("value") * severity, {"error": 400.0, "purchase": 100.0}, 50.0)
    band = F.when(F.col("score") >= 500, "high").when(F.col("score") >= 300, "medium").otherwise("low")
    return scored.select("user_id", F.round("score", 4).alias("score"), band.alias("band"))


@query("""WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM l GROUP BY 1""")
def latest_then_aggregate(t):
    latest = t.orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return latest.groupBy(F.col("l.o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("l.o_totalprice"), 4).alias("mean"))


@query("""SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_shipdate DESC, l_suppkey DESC) = 1""")
def best_row_per_deal(t):
    best = F.max_by(F.struct("l_suppkey", "l_extendedprice"), F.struct("l_extendedprice", "l_shipdate", "l_suppkey"))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.*")


@query("""WITH f AS (SELECT l_orderkey, min(l_linenumber) AS m FROM lineitem GROUP BY 1), d AS (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem),
c AS (SELECT p.l_suppkey AS investor, q.l_suppkey AS lead, count(*) AS n FROM d p JOIN f USING (l_orderkey) JOIN d q ON q.l_orderkey = p.l_orderkey AND q.l_linenumber = f.m WHERE p.l_suppkey <> q.l_suppkey GROUP BY 1, 2)
SELECT investor, lead, n FROM c QUALIFY row_number() OVER (PARTITION BY investor ORDER BY n DESC, lead) = 1""")
def lead_argmax(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber").distinct()
    first = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    leads = lines.join(first, ["l_orderkey", "l_linenumber"]).select("l_orderkey", F.col("l_suppkey").alias("lead"))
    pairs = lines.join(leads, "l_orderkey").filter("l_suppkey <> lead").groupBy(F.col("l_suppkey").alias("investor"), "lead").agg(F.count("*").alias("n"))
    return pairs.groupBy("investor").agg(F.max_by(F.struct("lead", "n"), F.struct("n", -F.col("lead"))).alias("b")).select("investor", "b.*")


@query("""WITH e AS (SELECT l_suppkey, l_shipdate, max(l_shipdate) OVER (PARTITION BY l_suppkey) AS last FROM lineitem)
SELECT l_suppkey, CAST(CAST(max(last) AS DATE) AS VARCHAR) AS last, count(*) FILTER (l_shipdate > TIMESTAMP '2000-01-01') / 4.0 AS per_quarter, count(*) FILTER (l_shipdate > last - INTERVAL 12 MONTH) AS trailing FROM e GROUP BY 1""")
def velocity_trailing(t):
    last = t.lineitem.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"))
    # One row per supplier of the small side: AQE broadcasts it where it fits.
    joined = t.lineitem.select("l_suppkey", "l_shipdate").join(last, "l_suppkey")
    recent = F.col("l_shipdate") > F.col("last") - F.expr("INTERVAL 12 MONTH")
    return joined.groupBy("l_suppkey").agg(F.max("last").cast("date").cast("string").alias("last"), (F.count_if(F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp_ntz")) / 4.0).alias("per_quarter"), F.count_if(recent).alias("trailing"))


@query("""WITH f AS (SELECT sn.n_name AS from_geo, cn.n_name AS to_geo, s_name, sum(l_extendedprice) AS usd, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey GROUP BY 1, 2, 3)
SELECT from_geo, to_geo, CAST(sum(n) AS BIGINT) AS n, round(sum(usd), 2) AS usd, array_to_string(list_sort(list(s_name))[1:8], '|') AS names FROM f GROUP BY 1, 2""")
def geo_flow(t):
    n1 = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("from_geo"))
    n2 = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_geo"))
    suppliers, buyers = t.supplier.join(n1, "s_nationkey"), t.orders.join(t.customer.join(n2, "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    flows = t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    by_name = flows.groupBy("from_geo", "to_geo", "s_name").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("usd"))
    first = F.row_number().over(Window.partitionBy("from_geo", "to_geo").orderBy("s_name"))
    eight = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 8, F.col("s_name")))), "|")
    return by_name.withColumn("r", first).groupBy("from_geo", "to_geo").agg(F.sum("n").alias("n"), F.round(F.sum("usd"), 2).alias("usd"), eight.alias("names"))


@query("""WITH p AS (SELECT p_partkey, p_type, avg(l_extendedprice / p_retailprice) AS roi FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT p_type AS sector, round(avg(roi), 6) AS roi, count(*) AS companies FROM p GROUP BY 1""")
def sector_roi(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    per_company = joined.groupBy("p_partkey", "p_type").agg(F.avg(F.col("l_extendedprice") / F.col("p_retailprice")).alias("roi"))
    return per_company.groupBy(F.col("p_type").alias("sector")).agg(F.round(F.avg("roi"), 6).alias("roi"), F.count("*").alias("companies"))


@query("""SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(DISTINCT event_type) AS sources FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 2""")
def contradicting_facts(t):
    return t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("event_type").alias("sources")).filter("sources > 2")


@query("""SELECT l_suppkey, count(*) AS deals, count(DISTINCT l_orderkey) AS companies, count(*) FILTER (l_extendedprice > 90000) AS unicorns, count(*) FILTER (l_returnflag = 'R') AS exits,
CAST(trunc(avg(nullif(CASE WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END, 0))) AS BIGINT) AS mean_check, CAST(trunc(sum(l_extendedprice)) AS BIGINT) AS deployed FROM lineitem GROUP BY 1""")
def investor_rollup(t):
    # Whole units are cut from exact sums: those of doubles depend on the order and may end just below a whole number.
    price = F.col("l_extendedprice").cast("decimal(20,4)")
    check = F.when((F.col("l_tax").isNull() | (F.col("l_tax") != 0)) & (price != 0), price)
    sums = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("deals"), F.countDistinct("l_orderkey").alias("companies"), F.count_if(F.col("l_extendedprice") > 90000).alias("unicorns"), F.count_if(F.col("l_returnflag") == "R").alias("exits"), F.sum(check).alias("checks"), F.count(check).alias("n"), F.sum(price).alias("all"))
    return sums.select("l_suppkey", "deals", "companies", "unicorns", "exits", F.expr("if(n = 0, null, checks div n)").alias("mean_check"), F.col("all").cast("long").alias("deployed"))


@query("""WITH d AS (SELECT source, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY 1), q AS (SELECT source, count(*) AS labelled, sum(quality) AS verified FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, docs, CAST(chars AS BIGINT) AS chars, coalesce(labelled, 0) AS labelled, CAST(coalesce(verified, 0) AS BIGINT) AS verified,
round(coalesce(chars * 1.0 / nullif(verified, 0), 0), 4) AS cost_per_verified FROM d LEFT JOIN q USING (source)""")
def source_kpis(t):
    sizes = t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    quality = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.sum("quality").alias("verified"))
    joined = sizes.join(quality, "source", "left").fillna(0, ["labelled", "verified"])
    return joined.select("source", "docs", "chars", "labelled", "verified", F.round(ratio(F.col("chars").cast("double"), F.nullif("verified", F.lit(0))), 4).alias("cost_per_verified"))


@query("""WITH p AS (SELECT quality, CASE WHEN n_chars > 1200 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)), k AS (SELECT unnest([0, 1]) AS class),
m AS (SELECT class, count(*) FILTER (predicted = class AND quality = class) AS tp, count(*) FILTER (predicted = class AND quality <> class) AS fp, count(*) FILTER (predicted <> class AND quality = class) AS fn FROM p, k GROUP BY 1)
SELECT class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM m""")
def clf_metrics(t):
    from ..operators.metrics import per_class

    predicted = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("gold"), F.when(F.col("n_chars") > 1200, 1).otherwise(0).alias("predicted"))
    return per_class(predicted, "gold", "predicted")


@query("""WITH p AS (SELECT toxic, least(0.95, greatest(0.05, n_chars / 8000.0)) AS p FROM labels JOIN documents USING (doc_id))
SELECT round(avg((p - toxic) * (p - toxic)), 6) AS brier, round(-avg(CASE WHEN toxic = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, count(*) AS n FROM p""")
def brier_logloss(t):
    from ..operators.metrics import probability_scores

    rows = t.labels.join(t.documents, "doc_id").select(clamp(F.col("n_chars") / 8000.0, 0.05, 0.95).alias("p"), F.col("toxic").alias("y"))
    return probability_scores(rows, "p", "y")


@query("""WITH m AS (SELECT year(o_orderdate) AS y, o_orderpriority AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.k AS metric, round(a.v, 4) AS before, round(b.v, 4) AS after, round((b.v - a.v) / abs(a.v), 6) AS change, -((b.v - a.v) / abs(a.v)) > 0.05 AS regressed FROM m a JOIN m b ON a.k = b.k AND a.y = 1999 AND b.y = 2000""")
def metric_regression_gate(t):
    yearly = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("v"))
    gate = agg.regression_gate(yearly.filter("y = 1999"), yearly.filter("y = 2000"), "metric", "v", 0.05, F.lit(False))
    return gate.withColumns({"before": F.round("before", 4), "after": F.round("after", 4), "change": F.round("change", 6)})


@query("""SELECT o_orderpriority AS domain, round(floor(1000 * (100.0 * sum(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0 END * (6 - CAST(left(o_orderpriority, 1) AS INTEGER))) / sum(6 - CAST(left(o_orderpriority, 1) AS INTEGER))) + 0.5) / 1000, 3) AS score FROM orders GROUP BY 1""")
def diligence_score(t):
    severity = 6 - F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    return t.orders.groupBy(F.col("o_orderpriority").alias("domain")).agg(half_up(100.0 * F.sum(status * severity) / F.sum(severity), 3).alias("score"))
