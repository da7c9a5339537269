"""Scores of leads, accounts and personas, watchlists, monitoring rules and writing style, over views of the tables.

The views give customers, orders and parts the fields that the operators ask for; their SQL runs on both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style
from ..functions import text as tx
from ..operators import identity, profiles, scores, triggers
from .registry import query


def _view(t, sql: str, *names: str):
    """The rows of sql over tables of t, under the tables' names."""
    return t.spark.sql(sql, **{n: getattr(t, n) for n in names})


_LEADS = """SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '@x.io') END AS email, c_mktsegment AS org, CASE WHEN c_custkey % 4 = 1 THEN '  ' WHEN c_custkey % 4 > 1 THEN 'partner' END AS title,
CASE WHEN c_custkey % 5 = 2 THEN '+15550100' END AS phone, CASE WHEN c_custkey % 11 < 4 THEN 'in/x' END AS linkedin_url, CASE WHEN c_nationkey < 20 THEN 'us' END AS country_iso2, CASE WHEN c_nationkey < 10 THEN 'paris' END AS city,
CASE WHEN c_custkey % 6 < 4 THEN 'founder' END AS persona_role, CASE WHEN c_custkey % 6 < 2 THEN 'vp' END AS seniority, CASE WHEN c_acctbal > 5000 THEN 'bio' END AS bio, c_custkey % 8 = 0 AS verified,
CASE c_custkey % 4 WHEN 0 THEN '["a", "b"]' WHEN 1 THEN '[]' WHEN 2 THEN '{{' END AS companies_json, CASE WHEN c_custkey % 5 = 1 THEN '["a"]' END AS board_seats_json, CASE WHEN c_custkey % 7 = 1 THEN '[1]' END AS awards_json, CASE WHEN c_custkey % 9 = 1 THEN '[{{"x": 1}}]' END AS exits_json FROM {customer}"""


@query("WITH v AS (" + _LEADS.format(customer="customer") + """), o AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1),
p AS (SELECT c_custkey, (SELECT count(*) FROM (SELECT unnest([name, email, org, title, phone, linkedin_url, country_iso2, city, persona_role, seniority, bio]) AS x) WHERE trim(x) <> '') / 11 AS completeness,
CASE WHEN verified THEN 0.5 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN phone IS NOT NULL OR linkedin_url IS NOT NULL THEN 0.25 ELSE 0 END AS verification, least(1.0, coalesce(n, 0) / 3) AS corroboration,
CASE WHEN last IS NULL THEN 0.0 ELSE pow(0.5, date_diff('day', last, DATE '2001-12-31') / 30.0) END AS freshness, CASE WHEN persona_role IS NULL THEN 0.0 WHEN seniority IS NULL THEN 0.5 ELSE 1.0 END AS persona_match,
((companies_json LIKE '[%a%')::INTEGER + 0 * 1) * 0.25 AS x, (coalesce(companies_json = '["a", "b"]', false)::INTEGER + (board_seats_json IS NOT NULL)::INTEGER + (awards_json IS NOT NULL)::INTEGER + (exits_json IS NOT NULL)::INTEGER) / 4 AS track_record FROM v LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, floor((0.3 * completeness + 0.2 * verification + 0.15 * corroboration + 0.15 * freshness + 0.1 * persona_match + 0.1 * track_record) * 1000 + 0.5) / 1000 AS score, floor(completeness * 1000 + 0.5) / 1000 AS completeness, floor(verification * 1000 + 0.5) / 1000 AS verification,
floor(corroboration * 1000 + 0.5) / 1000 AS corroboration, floor(freshness * 1000 + 0.5) / 1000 AS freshness, floor(persona_match * 1000 + 0.5) / 1000 AS persona_match, floor(track_record * 1000 + 0.5) / 1000 AS track_record FROM p""".replace("((companies_json LIKE '[%a%')::INTEGER + 0 * 1) * 0.25 AS x, ", ""))
def lead_quality_parts(t):
    """All six parts of every customer's quality as a lead."""
    orders = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("providers"), F.max("o_orderdate").alias("last_enriched_at"))
    leads = _view(t, _LEADS, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return profiles.lead_quality(leads, "c_custkey", F.lit("2001-12-31").cast("date"))


_ICP = {
    "industries": ["building", "auto parts"], "size_bands": ["51-200"], "size_min": 50, "size_max": 500, "geos": ["N3", "N7", "N12"], "stages": ["series a"], "weights": {"industry": 0.3, "size": 0.2, "geo": 0.15, "funding": 0.15, "buyer": 0.2},
    "roles": {"1-URGENT": ("f", "p", []), "cto": ("o", "s1", ["low"])},
}
_ACCOUNTS = """SELECT c_custkey AS account, CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 4 = 1 THEN '51-200' WHEN c_custkey % 4 = 2 THEN '1-10' END AS size_band, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 1000 END AS employees,
CASE WHEN c_custkey % 13 > 0 THEN concat('n', CAST(c_nationkey AS STRING)) END AS country, CASE WHEN c_custkey % 3 = 1 THEN 'Series A' WHEN c_custkey % 3 = 2 THEN 'seed' END AS stage FROM {customer}"""


@query("WITH a AS (" + _ACCOUNTS.format(customer="customer").replace("STRING", "VARCHAR") + """), b AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 WHEN o_orderstatus = 'F' AND 's' || month(o_orderdate) = 'p' THEN 0.6 ELSE 0 END) + max(CASE WHEN o_orderstatus = 'O' AND month(o_orderdate) = 1 OR contains(lower(o_orderpriority), 'low') THEN 0.6 ELSE 0 END) AS c FROM orders GROUP BY 1),
i AS (SELECT o_custkey, 100 * (1 - exp(-sum(exp(-date_diff('day', o_orderdate::DATE, DATE '2001-12-31') / 30.0)) / 25)) AS intent FROM orders GROUP BY 1),
p AS (SELECT account, CASE WHEN industry IS NULL THEN 0.0 WHEN lower(industry) = 'building' THEN 85.0 ELSE 0 END AS industry, CASE WHEN size_band = '51-200' AND (employees IS NULL OR employees = 0 OR employees BETWEEN 50 AND 500) THEN 100.0 WHEN employees BETWEEN 50 AND 500 THEN 85 WHEN employees > 500 THEN greatest(0, floor(60 - (employees - 500) / 500 * 60 + 0.5)) WHEN employees > 0 THEN greatest(0, floor(60 - (50 - employees) / 50 * 60 + 0.5)) WHEN size_band IS NOT NULL THEN 30 ELSE 0 END AS size,
CASE WHEN country IN ('n3', 'n7', 'n12') THEN 100.0 ELSE 0 END AS geo, CASE WHEN stage IS NULL THEN 30.0 WHEN stage = 'Series A' THEN 100 ELSE 20 END AS funding, least(100.0, floor(coalesce(c, 0) / 2 * 100 + 0.5)) AS buyer FROM a LEFT JOIN b ON o_custkey = account),
f AS (SELECT *, floor((0.3 * industry + 0.2 * size + 0.15 * geo + 0.15 * funding + 0.2 * buyer) * 100 + 0.5) / 100 AS fit FROM p)
SELECT f.*, floor((0.6 * coalesce(intent, 0) + 0.4 * fit) * 100 + 0.5) / 100 AS score FROM f LEFT JOIN i ON o_custkey = account""")
def account_scores(t):
    """Fit by five parts, and its blend with an intent score, of every customer."""
    accounts = _view(t, _ACCOUNTS, "customer").withColumn("industries", F.array_compact(F.array("industry")))
    buyers = t.orders.select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("department"), F.concat(F.lit("s"), F.month("o_orderdate").cast("string")).alias("seniority"), F.col("o_orderpriority").alias("title"))
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    intent = t.orders.groupBy(F.col("o_custkey").alias("account")).agg((100 * (1 - F.exp(-F.sum(F.exp(-age / 30)) / 25))).alias("intent"))
    fit = profiles.account_fit(accounts, buyers, _ICP)
    return fit.join(intent, "account", "left").withColumn("score", profiles.blend(F.col("intent"), F.col("fit"))).drop("intent")


_WEIGHTS = {"sector": 0.20, "geography": 0.15, "persona": 0.15, "seniority": 0.10, "financial": 0.15, "contact": 0.10, "quality": 0.10, "tags": 0.05}
_IDEAL = {"sector": ["BUILDING", "MACHINERY", "FURNITURE"], "geography": ["north", "us"], "persona": [], "seniority": ["vp", "partner"], "tags_any": ["a", "b"], "tags_all": [], "exclude_dnc": True}


@query("""WITH l AS (SELECT c_custkey AS id, c_mktsegment, CASE WHEN c_nationkey < 8 THEN 'north' END AS geo, CASE WHEN c_nationkey > 15 THEN 'US' END AS country, CASE c_custkey % 3 WHEN 0 THEN 'vp' WHEN 1 THEN 'partner' END AS seniority, c_custkey % 17 = 0 AS dnc, c_custkey % 4 AS tag, c_acctbal, c_custkey % 5 = 0 AS mail FROM customer)
SELECT id, floor((0.6 + CASE WHEN c_acctbal > 2000 THEN 0.15 ELSE 0 END + CASE WHEN mail THEN 0.1 ELSE 0 END + 0.05 + 0.05) * 10000 + 0.5) / 10000 AS score, 'sector,geography,seniority' || CASE WHEN c_acctbal > 2000 THEN ',financial' ELSE '' END || CASE WHEN mail THEN ',contact' ELSE '' END || ',tags' AS reasons
FROM l WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND (geo IS NOT NULL OR country IS NOT NULL) AND seniority IS NOT NULL AND NOT dnc AND tag IN (0, 1)""")
def icp_match_weights(t):
    """Eight weights, filters and reasons for every customer."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    leads = t.customer.select(
        key.alias("id"), F.col("c_mktsegment").alias("sector"), F.when(nation < 8, "north").alias("geo"), F.when(nation > 15, "US").alias("country"), F.lit(None).cast("string").alias("persona_role"),
        F.when(key % 3 == 0, "vp").when(key % 3 == 1, "partner").alias("seniority"), (key % 17 == 0).alias("do_not_contact"), F.array(F.when(key % 4 == 0, "a").when(key % 4 == 1, "b").when(key % 4 == 2, "c").otherwise("d")).alias("tags"),
        F.when(F.col("c_acctbal") > 2000, F.col("c_acctbal")).alias("aum"), F.lit(None).cast("double").alias("fund_size"), F.when(key % 5 == 0, "x@y.io").alias("email"), F.lit(None).cast("string").alias("linkedin_url"),
    )
    return profiles.icp_match(leads, _IDEAL, _WEIGHTS)


_PERSONA = {
    "size_min": 100, "size_max": 400, "size_bands": ["11-50"], "geos": ["de", "emea", "apac"], "industries": ["building"], "techs_required": ["t1"], "techs_preferred": ["t2", "t3"], "techs_excluded": ["t9"],
    "signal_kinds": ["1-urgent", "2-high"], "buyer_titles": ["urgent", "high"], "buyer_seniority": ["f"], "buyer_departments": [], "hard": {"require_domain": True, "exclude_countries": ["fr"]},
}
_COUNTRIES = "['de', 'fr', 'gb', 'jp', 'us', 'br', 'in', 'es']"


@query(f"""WITH a AS (SELECT c_custkey AS account, {_COUNTRIES}[c_nationkey % 9 + 1] AS country, CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 2000 END AS employees, CASE WHEN c_custkey % 6 = 0 THEN '11-50' END AS band, lower(c_mktsegment) AS industry, c_custkey % 7 AS tech, CASE WHEN c_acctbal > 0 THEN c_acctbal / 10000 END AS cosine, c_custkey % 19 > 0 AS domain FROM customer),
s AS (SELECT o_custkey, max(o_orderdate)::DATE AS modified, sum(3.0 * 0.9 * exp(-greatest(0, date_diff('day', o_orderdate::DATE, DATE '2001-12-31')) / 30.0) * CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.25 END) AS credit,
max(floor(CASE WHEN o_totalprice > 400000 THEN least(80, 50 * (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER + 30 * (o_orderstatus = 'F')::INTEGER + 5) ELSE 50 * (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER + 30 * (o_orderstatus = 'F')::INTEGER END / 80 * 100 + 0.5)) AS buyer FROM orders GROUP BY 1),
p AS (SELECT account, domain AND coalesce(country <> 'fr', true) AND tech <> 0 AND tech <> 6 AS ok, CASE WHEN band IS NOT NULL THEN 100.0 WHEN employees IS NULL THEN 25 WHEN employees BETWEEN 100 AND 400 THEN 100 WHEN employees < 100 THEN greatest(0, 100 - floor(log10(100 / greatest(1, employees)) * 60 + 0.5)) ELSE greatest(0, 100 - floor(log10(employees / 400) * 60 + 0.5)) END AS size,
CASE WHEN country IS NULL THEN 20.0 WHEN country = 'de' THEN 100 WHEN country IN ('gb', 'es', 'fr', 'jp', 'in') THEN 80 ELSE 0 END AS geo, CASE WHEN industry = 'building' THEN 100.0 ELSE 0 END AS industry, CASE WHEN tech IN (2, 3) THEN 80.0 WHEN tech = 4 THEN 100 ELSE 60 END AS tech,
CASE WHEN credit IS NULL THEN 0.0 ELSE floor(100 * (1 - exp(-credit / 15)) + 0.5) END AS signal, coalesce(buyer, 0.0) AS buyer, CASE WHEN cosine IS NULL THEN 50.0 WHEN cosine < 0.55 THEN 0 ELSE floor(least(1, (cosine - 0.4) / 0.5) * 100 + 0.5) END AS semantic,
CASE WHEN date_diff('day', modified, DATE '2001-12-31') <= 7 THEN 1.15 WHEN date_diff('day', modified, DATE '2001-12-31') <= 30 THEN 1.05 ELSE 1.0 END AS boost FROM a LEFT JOIN s ON o_custkey = account)
SELECT account, CASE WHEN ok THEN floor(least(100, (0.1 * size + 0.1 * geo + 0.2 * industry + 0.1 * tech + 0.2 * signal + 0.1 * buyer + 0.2 * semantic) * boost) + 0.5) ELSE 0 END::DOUBLE AS fit, CASE WHEN ok THEN size ELSE 0 END AS size, CASE WHEN ok THEN geo ELSE 0 END AS geo, CASE WHEN ok THEN industry ELSE 0 END AS industry,
CASE WHEN ok THEN tech ELSE 0 END AS tech, CASE WHEN ok THEN signal ELSE 0 END AS signal, CASE WHEN ok THEN buyer ELSE 0 END AS buyer, CASE WHEN ok THEN semantic ELSE 0 END AS semantic FROM p""")
def persona_fit_parts(t):
    """Hard filters and seven parts of a persona for every customer, with orders as signals and buyers."""
    key = F.col("c_custkey")
    countries = F.array(*(F.lit(c) for c in ("de", "fr", "gb", "jp", "us", "br", "in", "es")))
    tech = key % 7
    techs = F.when(tech == 0, F.array()).when(tech == 6, F.array(F.lit("T1"), F.lit("t9"))).when(tech == 4, F.array(F.lit("t1"), F.lit("t2"), F.lit("t3"))).when(tech.isin(2, 3), F.array(F.lit("t1"), F.concat(F.lit("t"), tech.cast("string")))).otherwise(F.array(F.lit("t1")))
    orders = t.orders.groupBy(F.col("o_custkey").alias("account")).agg(
        F.collect_list(F.struct(F.col("o_orderpriority").alias("kind"), F.lit(3.0).alias("weight"), F.lit(0.9).alias("confidence"), F.col("o_orderdate").cast("date").alias("at"))).alias("signals"),
        F.collect_list(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("seniority"), F.lit(None).cast("string").alias("department"), (F.col("o_totalprice") > 400000).alias("decides"))).alias("buyers"),
        F.max("o_orderdate").alias("modified"),
    )
    accounts = t.customer.select(
        key.alias("account"), F.lit("open").alias("status"), F.get(countries, (F.col("c_nationkey") % 9).cast("int")).alias("country"), F.lit("seed").alias("stage"), F.when(key % 19 > 0, "x.io").alias("domain"), F.when(key % 10 > 0, key % 2000).alias("employees"),
        F.when(key % 6 == 0, "11-50").alias("size_band"), F.col("c_mktsegment").alias("industry"), F.array().cast("array<string>").alias("industries"), techs.cast("array<string>").alias("techs"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("cosine"),
    )
    return profiles.persona_fit(accounts.join(orders, "account", "left"), _PERSONA, F.lit("2001-12-31").cast("date"))


_RUNGS = ["analyst", "associate", "principal", "vp", "director", "partner"]
_STAGES = ["pre_seed", "seed", "series_a", "series_b", "series_c", "growth"]


@query("""WITH e AS (SELECT c_custkey AS id, ['analyst', 'associate', 'principal', 'vp', 'director', 'partner', 'clown'][c_custkey % 7 + 1] AS rung, ['Marketing Operations', 'engineering', 'Trading desks', 'sales'][c_custkey % 4 + 1] AS dept, ['fintech', 'software', 'saas', 'food'][c_custkey % 4 + 1] AS industry, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 900 END AS staff,
['seed', 'series_a', 'series_c', 'none'][c_custkey % 4 + 1] AS stage, c_nationkey * 7 - 80.0 AS lat, c_nationkey * 14 - 170.0 AS lon FROM customer),
p AS (SELECT id, CASE rung WHEN 'vp' THEN 1.0 WHEN 'principal' THEN 0.6 WHEN 'director' THEN 0.6 WHEN 'associate' THEN 0.2 WHEN 'partner' THEN 0.2 ELSE 0 END AS seniority, CASE dept WHEN 'Marketing Operations' THEN 1.0 WHEN 'Trading desks' THEN 0.375 ELSE 0 END AS function_, CASE industry WHEN 'software' THEN 1.0 WHEN 'saas' THEN 0.7 ELSE 0 END AS industry,
CASE WHEN staff IS NULL THEN 0.0 WHEN staff BETWEEN 50 AND 200 THEN 1 WHEN staff BETWEEN 25 AND 300 THEN 0.5 ELSE 0 END AS size, CASE stage WHEN 'seed' THEN 0.6 WHEN 'series_a' THEN 1.0 ELSE 0 END AS stage,
exp(-2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon - 20.0) / 2), 2)))) / 4000.0) AS geo FROM e),
w AS (SELECT id, (0.15 * seniority + 0.15 * function_ + 0.15 * industry + 0.1 * size + 0.1 * stage + 0.1 * geo) / 0.75 AS score, [{'n': 'seniority', 'i': 0, 'v': 0.15 * seniority}, {'n': 'function', 'i': 1, 'v': 0.15 * function_}, {'n': 'industry', 'i': 2, 'v': 0.15 * industry}, {'n': 'company_size', 'i': 3, 'v': 0.1 * size}, {'n': 'stage', 'i': 4, 'v': 0.1 * stage}, {'n': 'geo', 'i': 5, 'v': 0.1 * geo}] AS parts FROM p),
x AS (SELECT id, unnest(parts) AS e FROM w), r AS (SELECT id, e.n AS n, row_number() OVER (PARTITION BY id ORDER BY e.v DESC, e.i) AS k FROM x) SELECT w.id, round(any_value(score), 6) AS score, string_agg(n, ',' ORDER BY k) AS drivers FROM w JOIN r ON r.id = w.id WHERE k <= 3 GROUP BY 1""")
def persona_match(t):
    """Ladder distance, stemmed overlap, parent industries, adjacent sizes and stages, and distance, for every customer."""
    key = F.col("c_custkey")
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (key % len(names)).cast("int"))
    lat, lon = F.col("c_nationkey") * 7 - 80.0, F.col("c_nationkey") * 14 - 170.0
    parts = {
        "seniority": (profiles.ladder_closeness(pick(*_RUNGS, "clown"), ["vp"], _RUNGS, (1.0, 0.6, 0.2)), 0.15),
        "function": (profiles.function_overlap(pick("Marketing Operations", "engineering", "Trading desks", "sales"), ["market operation", "trade desk funds"]), 0.15),
        "industry": (profiles.industry_closeness(F.array(pick("fintech", "software", "saas", "food")), ["software"], {"fintech": ["finance"], "saas": ["software"]}), 0.15),
        "company_size": (profiles.size_closeness(F.when(key % 5 > 0, key % 900), 50, 200), 0.1),
        "stage": (profiles.ladder_closeness(pick("seed", "series_a", "series_c", "none"), ["series_a"], _STAGES, (1.0, 0.6)), 0.1),
        "geo": (profiles.geo_closeness(lat, lon, (10.0, 20.0), 4000.0), 0.1),
    }
    mean, drivers = profiles.weighted_mean(parts)
    return t.customer.select(key.alias("id"), F.round(mean, 6).alias("score"), drivers.alias("drivers"))


@query("""WITH c AS (SELECT l_partkey AS fact, l_suppkey % 40 AS host, CASE WHEN l_tax >= 0.02 THEN 0.9 WHEN l_tax >= 0.01 THEN 0.7 ELSE 0.3 END AS rep, l_returnflag = 'R' AND l_linenumber = 7 AS gov, l_linestatus = 'F' AND l_quantity > 45 AS archived, l_shipdate::DATE AS d, CASE WHEN l_discount > 0.08 THEN 0.5 ELSE 0 END AS mood, l_quantity < 8 AS contra FROM lineitem)
SELECT fact, round(greatest(0, least(1, 0.3 * count(DISTINCT CASE WHEN rep >= 0.7 THEN host END) + 0.2 * max(CASE WHEN rep >= 0.9 THEN 1 ELSE 0 END) + 0.2 * max(CASE WHEN gov THEN 1 ELSE 0 END) + 0.15 * max(CASE WHEN archived THEN 1 ELSE 0 END)
+ 0.1 * max(CASE WHEN date_diff('day', d, DATE '2001-12-31') < 30 THEN 1.0 WHEN date_diff('day', d, DATE '2001-12-31') < 180 THEN 0.5 WHEN date_diff('day', d, DATE '2001-12-31') < 365 THEN 0.2 ELSE 0 END) + 0.05 * count(CASE WHEN mood > 0.2 THEN 1 END) - 0.1 * count(CASE WHEN contra THEN 1 END))), 4)::DOUBLE AS verified FROM c WHERE fact % 2 = 0 OR d < DATE '1996-01-01' GROUP BY 1""".replace(" WHERE fact % 2 = 0 OR d < DATE '1996-01-01'", ""))
def verified_citations(t):
    """All eight signals of a fact's citations: lines stand for citations of a part by suppliers."""
    tax = F.col("l_tax")
    citations = t.lineitem.select(
        F.col("l_partkey").alias("fact"), (F.col("l_suppkey") % 40).alias("host"), F.when(tax >= 0.02, 0.9).when(tax >= 0.01, 0.7).otherwise(0.3).alias("reputability"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)).alias("government"),
        ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)).alias("archived"), F.col("l_shipdate").alias("published"), F.when(F.col("l_discount") > 0.08, 0.5).otherwise(0.0).alias("sentiment"), (F.col("l_quantity") < 8).alias("contradicts"),
    )
    return scores.verified(citations, "fact", F.lit("2001-12-31").cast("date")).withColumn("verified", F.round("verified", 4))


_LISTED = """SELECT s_suppkey AS id, concat('Mr ', split_part(s_name, '#', 1), CASE s_suppkey % 4 WHEN 0 THEN ' Knight' WHEN 1 THEN ' Schmidt' WHEN 2 THEN ' Thorne' ELSE ' Phelps' END) AS name, CASE WHEN s_suppkey % 3 > 0 THEN CAST(1950 + s_suppkey % 5 AS {text}) END AS dob, CASE WHEN s_suppkey % 2 = 0 THEN concat('n', CAST(s_nationkey % 3 AS {text})) END AS country FROM {supplier}"""
_ASKED = """SELECT c_custkey AS q, concat(CASE c_custkey % 3 WHEN 0 THEN 'Supplier' WHEN 1 THEN 'suplier' ELSE 'Customer' END, CASE c_custkey % 5 WHEN 0 THEN ' Night' WHEN 1 THEN ' Schmitt' WHEN 2 THEN ' Thorn Jr' WHEN 3 THEN ' Felps' ELSE ' Unknown' END) AS name, CASE WHEN c_custkey % 2 = 0 THEN CAST(1950 + c_custkey % 5 AS {text}) END AS dob, concat('n', CAST(c_nationkey % 3 AS {text})) AS country FROM {customer} WHERE c_custkey % 50 = 0"""


@query()
def watchlist_match(t):
    """Every fiftieth customer, under a changed name, against all suppliers: exact, phonetic and fuzzy, with gates."""
    listed = _view(t, _LISTED.replace("{text}", "STRING"), "supplier")
    asked = _view(t, _ASKED.replace("{text}", "STRING"), "customer")
    found = identity.watchlist(asked, listed, 0.6)
    return found.withColumn("score", F.round("score", 4))


_SNAPSHOTS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders),
p AS (SELECT n.o_custkey AS entity, o.o_orderkey AS ok, n.o_orderpriority AS title, o.o_orderpriority AS otitle, n.o_orderstatus AS role, o.o_orderstatus AS orole, year(n.o_orderdate) % 4 AS emp, year(o.o_orderdate) % 4 AS oemp, month(n.o_orderdate) % 5 AS city, month(o.o_orderdate) % 5 AS ocity, quarter(n.o_orderdate) AS country, quarter(o.o_orderdate) AS ocountry,
n.o_totalprice / 5000 AS fit, o.o_totalprice / 5000 AS ofit, n.o_totalprice / 60000 AS intent, o.o_totalprice / 60000 AS ointent, n.o_orderkey % 40 AS risk, o.o_orderkey % 40 AS orisk, n.o_orderkey % 3 AS low, o.o_orderkey % 3 AS olow, n.o_orderkey % 2 AS high, o.o_orderkey % 2 AS ohigh, n.o_orderkey % 4 AS handles, o.o_orderkey % 4 AS ohandles
FROM r n LEFT JOIN r o ON o.o_custkey = n.o_custkey AND o.i = 2 WHERE n.i = 1), b AS (SELECT * FROM p WHERE ok IS NOT NULL), d AS (SELECT entity, 'any_change' AS kind, array_to_string(list_filter([CASE WHEN city <> ocity THEN 'city' END, CASE WHEN country <> ocountry THEN 'country' END, CASE WHEN low <> olow OR high <> ohigh THEN 'dd_findings' END, CASE WHEN risk <> orisk THEN 'dd_risk_score' END,
CASE WHEN emp <> oemp THEN 'employer' END, CASE WHEN emp <> oemp THEN 'employer_id' END, CASE WHEN fit <> ofit THEN 'fit_max_score' END, CASE WHEN handles <> ohandles THEN 'handles_count' END, CASE WHEN intent <> ointent THEN 'intent_score' END, CASE WHEN role <> orole THEN 'role' END, CASE WHEN title <> otitle THEN 'title' END], lambda x: x IS NOT NULL), ',') AS key FROM b
UNION ALL SELECT entity, 'title_change', title FROM b WHERE title <> otitle UNION ALL SELECT entity, 'new_employer', emp::VARCHAR FROM b WHERE emp <> oemp UNION ALL SELECT entity, 'geo_change', city || '|' || country FROM b WHERE city <> ocity OR country <> ocountry
UNION ALL SELECT entity, 'fit_score_change', round(fit)::BIGINT::VARCHAR FROM b WHERE abs(fit - ofit) >= 5 UNION ALL SELECT entity, 'intent_score_change', round(intent)::BIGINT::VARCHAR FROM b WHERE abs(intent - ointent) >= 5 UNION ALL SELECT entity, 'dd_score_change', risk::VARCHAR FROM b WHERE abs(risk - orisk) >= 5
UNION ALL SELECT entity, 'dd_finding_new', CASE WHEN low > olow AND high > ohigh THEN 'low,high' WHEN low > olow THEN 'low' ELSE 'high' END FROM b WHERE low > olow OR high > ohigh UNION ALL SELECT entity, 'handle_added', ohandles || '->' || handles FROM b WHERE handles > ohandles
UNION ALL SELECT entity, 'executive_change', title || '|' || role FROM b WHERE role <> orole OR title <> otitle) """


@query(_SNAPSHOTS + "SELECT entity, kind, key AS dedupe_key FROM d WHERE key <> ''")
def summary_rules(t):
    """The ten rules on summaries: each customer's last two orders stand for its summaries."""
    from pyspark.sql import Window

    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    findings = F.struct((key % 3).alias("low"), F.lit(0).cast("long").alias("medium"), (key % 2).alias("high"), F.lit(0).cast("long").alias("critical"))
    summary = F.struct(
        F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("role"), (F.year(at) % 4).cast("string").alias("employer"), (F.year(at) % 4).alias("employer_id"), (F.month(at) % 5).alias("city"), F.quarter(at).alias("country"),
        (F.col("o_totalprice") / 5000).alias("fit_max_score"), (F.col("o_totalprice") / 60000).alias("intent_score"), (key % 40).alias("dd_risk_score"), findings.alias("dd_findings"), (key % 4).alias("handles_count"),
    )
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = t.orders.select(F.col("o_custkey").alias("entity"), F.row_number().over(w).alias("i"), summary.alias("new"), F.lead(summary).over(w).alias("old")).filter("i = 1")
    return triggers.summary_triggers(last)


_FEEDS = """WITH e AS (SELECT event_id AS id, user_id AS entity, ts AS at1, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), o AS (SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate AS at1, o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS usd FROM orders),
n AS (SELECT *, CASE k % 10 WHEN 3 THEN 'Lawsuit filed' WHEN 4 THEN 'Raises Series B' ELSE 'Profile' END AS title, CASE WHEN k % 13 = 0 THEN 'Negative' END AS mood FROM e WHERE event_type = 'view'),
f AS (SELECT 'new_news_item' AS kind, 0 AS rank, entity, id, at1 FROM n UNION ALL SELECT 'adverse_media', 0, entity, id, at1 FROM n WHERE title = 'Lawsuit filed' OR mood = 'Negative' UNION ALL SELECT 'funding_event', 1, entity, id, at1 FROM n WHERE title = 'Raises Series B' UNION ALL SELECT 'funding_event', 0, entity % 50, id, at1 FROM o WHERE usd > 450000
UNION ALL SELECT unnest(['new_investment', 'new_portfolio_addition']), 0, entity, id, at1 FROM o UNION ALL SELECT CASE k % 3 WHEN 0 THEN 'new_tweet' WHEN 1 THEN 'new_podcast' ELSE 'new_post' END, 0, entity, id, at1 FROM e WHERE event_type = 'click' UNION ALL SELECT 'prediction_above_threshold', 0, entity, id, at1 FROM e WHERE event_type = 'signup' AND value / 100 >= 0.7
UNION ALL SELECT 'relationship_change', 0, entity, id, at1 FROM e WHERE event_type = 'purchase' UNION ALL SELECT 'partner_movement_match', 0, entity % 10, id, at1 FROM o WHERE s = 'F' AND p IN ('1-URGENT', '2-HIGH') UNION ALL SELECT 'new_fund_match', 0, entity % 10, id, at1 FROM o WHERE usd >= 300000 AND p IN ('3-MEDIUM')
UNION ALL SELECT 'sec_filing_match', 0, entity % 10, id, at1 FROM o WHERE p IN ('5-LOW') UNION ALL SELECT 'pe_deal_match', 0, entity % 10, id, at1 FROM o WHERE usd >= 200000 AND s IN ('O')),
g AS (SELECT kind, entity, rank, arg_max(id, (at1, id::VARCHAR))::VARCHAR AS key, count(*) AS n FROM f WHERE entity % 2 = 1 OR at1 > TIMESTAMP '1999-06-01' GROUP BY 1, 2, 3) SELECT entity, kind, arg_min(key, rank) AS dedupe_key, arg_min(n, rank) AS n FROM g GROUP BY 1, 2"""


@query(_FEEDS)
def feed_rules(t):
    """The fourteen rules on feeds, with a watermark for every entity of even id: events and orders stand for the feeds."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("ts").alias("at"), "event_type", "value", k.alias("k"))
    title = F.when(F.col("k") % 10 == 3, "Lawsuit filed").when(F.col("k") % 10 == 4, "Raises Series B").otherwise("Profile")
    news = triggers.news_feeds(events.filter("event_type = 'view'").withColumn("title", title).withColumn("sentiment", F.when(F.col("k") % 13 == 0, "Negative")))
    deals = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("usd"))
    clicks, watched = events.filter("event_type = 'click'"), deals.withColumn("entity", F.col("entity") % 10)
    feeds = {
        "new_news_item": news["new_news_item"], "adverse_media": news["adverse_media"], "funding_event:1": news["funding_event"], "funding_event": deals.filter("usd > 450000").withColumn("entity", F.col("entity") % 50),
        "new_investment": deals, "new_portfolio_addition": deals, "new_tweet": clicks.filter("k % 3 = 0"), "new_podcast": clicks.filter("k % 3 = 1"), "new_post": clicks.filter("k % 3 = 2"), "prediction_above_threshold": events.filter("event_type = 'signup' and value / 100 >= 0.7"),
        "relationship_change": events.filter("event_type = 'purchase'"), "partner_movement_match": triggers.matching(watched, {"status": ["F"], "kind": ["1-URGENT", "2-HIGH"]}), "new_fund_match": triggers.matching(watched, {"kind": ["3-MEDIUM"]}, {"usd": 300000}),
        "sec_filing_match": triggers.matching(watched, {"kind": ["5-LOW"]}), "pe_deal_match": triggers.matching(watched, {"status": ["O"]}, {"usd": 200000}),
    }
    seen = t.events.select(F.col("user_id").alias("entity")).unionByName(t.orders.select(F.col("o_custkey").alias("entity"))).unionByName(t.orders.select((F.col("o_custkey") % 50).alias("entity"))).unionByName(watched.select("entity")).distinct()
    since = seen.filter("entity % 2 = 0").withColumn("since", F.lit("1999-06-01").cast("timestamp_ntz"))
    return triggers.feed_triggers(feeds, since, -(-(t.events.count() + t.orders.count()) // 250_000))


@query()
def stylometry_vectors(t):
    """All 32 features of every document's style, rounded."""
    return style.vectors(t.documents).select("doc_id", *(F.round(c, 6).alias(c) for c in style.NAMES))


@query()
def stylometry_turns(t):
    """Conversations whose two sides write alike: the cosine of all features is 0.92 at least."""
    said = t.conversations.groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    v = style.vectors(said.select(F.struct("conv_id", "role").alias("doc_id"), "text")).select("doc_id.*", F.struct(*style.NAMES).alias("v"))
    sides = v.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("v"))).alias("a"), F.max(F.when(F.col("role") == "assistant", F.col("v"))).alias("b")).filter("a is not null and b is not null")
    return sides.select("conv_id", F.round(style.likeness("a", "b"), 6).alias("cosine")).filter("cosine >= 0.92")


@query(r"""WITH p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '+1 (555) 010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '555.010.' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '1-555-010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 3 THEN '12345' WHEN 4 THEN '+44 20 ' || c_custkey || ' ext' ELSE NULL END AS raw FROM customer),
d AS (SELECT c_custkey, regexp_replace(raw, '[^0-9+]', '', 'g') AS d FROM p) SELECT c_custkey, CASE WHEN starts_with(d, '+') THEN CASE WHEN length(d) BETWEEN 8 AND 16 THEN d END WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 THEN '+' || d END AS phone FROM d""")
def phone_keys(t):
    number = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    turn = F.col("c_custkey") % 6
    raw = F.when(turn == 0, F.concat(F.lit("+1 (555) 010-"), number)).when(turn == 1, F.concat(F.lit("555.010."), number)).when(turn == 2, F.concat(F.lit("1-555-010-"), number)).when(turn == 3, "12345").when(turn == 4, F.concat(F.lit("+44 20 "), F.col("c_custkey").cast("string"), F.lit(" ext")))
    return t.customer.select("c_custkey", tx.phone_key(raw).alias("phone"))


_FACTS = """SELECT concat('s', CAST(l_suppkey AS {text})) AS entity, CASE l_orderkey % 10 WHEN 0 THEN 'career' WHEN 1 THEN 'past_career' WHEN 2 THEN 'education' WHEN 3 THEN 'board_seat' WHEN 4 THEN 'advisory' WHEN 5 THEN 'investment' WHEN 6 THEN 'portfolio' WHEN 7 THEN 'family' WHEN 8 THEN 'publication' ELSE 'mention' END AS predicate,
concat('p', CAST(l_partkey AS {text})) AS object, CASE l_returnflag WHEN 'R' THEN 'sec.form4.x' WHEN 'A' THEN 'press' ELSE 'tweet' END AS source, CAST(l_shipdate AS DATE) AS started, CASE WHEN l_quantity > 10 THEN CAST(l_shipdate AS DATE) + INTERVAL '400' DAY END AS ended FROM {lineitem}"""


@query("WITH f AS (" + _FACTS.replace("{text}", "VARCHAR").replace("{lineitem}", "lineitem") + """), s AS (SELECT entity AS src, object AS dst, CASE predicate WHEN 'career' THEN 'works_at' WHEN 'past_career' THEN 'worked_at' WHEN 'education' THEN 'studied_at' WHEN 'board_seat' THEN 'board_member_at' WHEN 'advisory' THEN 'advises' WHEN 'investment' THEN 'invested_in' WHEN 'portfolio' THEN 'portfolio_of' WHEN 'family' THEN 'family_of' END AS kind,
CASE predicate WHEN 'career' THEN 0.85 WHEN 'past_career' THEN 0.8 WHEN 'education' THEN 0.7 WHEN 'board_seat' THEN CASE source WHEN 'sec.form4.x' THEN 0.95 ELSE 0.85 END WHEN 'advisory' THEN 0.7 WHEN 'investment' THEN CASE source WHEN 'sec.form4.x' THEN 0.95 WHEN 'press' THEN 0.7 ELSE 0.8 END WHEN 'portfolio' THEN 0.9 ELSE 0.6 END AS base FROM f WHERE predicate NOT IN ('publication', 'mention')),
e AS (SELECT predicate, object, entity, min(started) AS s, max(coalesce(ended, DATE '9999-12-31')) AS e FROM f WHERE predicate IN ('career', 'education', 'investment', 'publication', 'mention') GROUP BY 1, 2, 3),
m AS (SELECT a.entity AS src, b.entity AS dst, a.predicate AS p FROM e a JOIN e b ON a.predicate = b.predicate AND a.object = b.object AND a.entity < b.entity WHERE (a.s <= b.e AND b.s <= a.e) OR a.predicate IN ('investment', 'publication', 'mention')),
u AS (FROM s UNION ALL SELECT src, dst, CASE p WHEN 'career' THEN 'colleague_of' WHEN 'education' THEN 'school_with' WHEN 'investment' THEN 'co_invested_with' WHEN 'publication' THEN 'co_authored_with' ELSE 'publicly_mentioned_with' END, CASE p WHEN 'career' THEN 0.7 WHEN 'education' THEN 0.55 WHEN 'investment' THEN 0.9 WHEN 'publication' THEN 0.75 ELSE 0.4 END FROM m)
SELECT src, dst, kind, count(*) AS evidence, round(least(1.0, max(base) + 0.05 * (count(*) - 1)), 4)::DOUBLE AS quality FROM u GROUP BY 1, 2, 3""")
def edge_extract(t):
    """All thirteen kinds of edges: lines stand for facts of suppliers about parts."""
    from ..operators.relations import extract_edges

    return extract_edges(_view(t, _FACTS.replace("{text}", "STRING"), "lineitem"))


_PROJECT = {"status": "a", "industries": ["BUILDING", "MACHINERY"], "funding_target": 30000}


@query("""WITH c AS (SELECT c_custkey AS id, least(100, greatest(0, c_acctbal / 80)) AS persona, 0.4::DOUBLE + c_nationkey / 50 AS cosine, c_custkey % 120 AS intent, c_custkey % 14 AS recent, c_mktsegment AS seg, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS stg, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 9 * 1000.0 + 500 END AS lo,
c_custkey % 5 = 0 AS rival, c_custkey % 7 AS icp, c_custkey % 4 AS ind, c_custkey % 2 = 0 AS sen, c_custkey % 101 AS early FROM customer), k AS (SELECT *, 0.6 * least(100, intent) + 0.4 * least(10, recent) * 10 AS cust FROM c),
o AS (SELECT id, persona, least(100, greatest(0, (cosine - 0.45) / 0.4 * 100)) AS sem, unnest([{'a': 'customer', 'o': cust}, {'a': 'investor', 'o': 0.4 * CASE stg WHEN 'a' THEN 100 WHEN 'b' THEN 30 ELSE 50 END + 0.3 * CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 50 ELSE 0 END + 0.3 * CASE WHEN lo IS NULL THEN 50 WHEN lo > 3000 THEN 100 - least(1, (lo - 3000) / lo) * 100 WHEN 2 * lo < 3000 THEN 100 - least(1, (3000 - 2 * lo) / (2 * lo)) * 100 ELSE 100 END},
{'a': 'partner', 'o': 0.5 * CASE WHEN rival THEN 0 ELSE 100 END + 0.5 * least(5, icp) * 20}, {'a': 'hire', 'o': 0.5 * least(3, ind) * 33 + 0.5 * CASE WHEN sen THEN 100 ELSE 40 END}, {'a': 'design_partner', 'o': 0.6 * cust + 0.4 * least(100, early)}]) AS x FROM k)
SELECT id, x.a AS audience, round(least(100, 0.4 * persona + 0.4 * sem + 0.2 * x.o), 6) AS fit FROM o""")
def audience_scores(t):
    """All five audiences for every customer."""
    key = F.col("c_custkey")
    low = F.when(key % 4 > 0, key % 9 * 1000.0 + 500)
    rows = t.customer.select(
        key.alias("id"), (F.col("c_acctbal") / 80).alias("persona"), (0.4 + F.col("c_nationkey") / 50.0).alias("cosine"), (key % 120).alias("intent"), (key % 14).alias("recent"), F.array("c_mktsegment").alias("sectors"),
        F.when(key % 3 == 0, F.array(F.lit("a"))).when(key % 3 == 1, F.array(F.lit("b"))).alias("stages"), low.alias("check_min"), (low * 2).alias("check_max"), (key % 5 == 0).alias("is_competitor"), (key % 7).alias("shared_icp"),
        (key % 4).alias("shared_industries"), (key % 2 == 0).alias("seniority_match"), (key % 101).alias("early_adopter"),
    )
    fits = F.array(*(F.struct(F.lit(a).alias("audience"), F.round(profiles.audience_fit(F.col("persona"), F.col("cosine"), a, _PROJECT), 6).alias("fit")) for a in profiles.AUDIENCES))
    return rows.select("id", F.explode(fits).alias("f")).select("id", "f.*")


@query("""WITH e AS (SELECT user_id, lower(event_type) AS method, max(least(0.3 + value / 50, CASE event_type WHEN 'purchase' THEN 0.98 WHEN 'view' THEN 0.6 WHEN 'click' THEN 0.75 ELSE 0.9 END)) AS c FROM events WHERE user_id % 2 = 0 OR event_type IN ('purchase', 'view') GROUP BY 1, 2), g AS (SELECT user_id, max((c, method)) AS b, count(*) AS n FROM e GROUP BY 1),
f AS (SELECT user_id, b[2] AS method, CASE WHEN n >= 2 THEN least(0.99, b[1] + 0.07 * (n - 1)) ELSE b[1] END AS confidence, n AS methods FROM g) SELECT user_id, method, round(confidence, 6) AS confidence, methods, confidence >= 0.95 AND (method = 'purchase' OR methods >= 2) AS auto_link FROM f""".replace(" WHERE user_id % 2 = 0 OR event_type IN ('purchase', 'view')", ""))
def hit_fusion_caps(t):
    hits = t.events.select("user_id", F.lower("event_type").alias("method"), (0.3 + F.col("value") / 50).alias("confidence"))
    found = scores.fuse_hits(hits, ["user_id"], {"purchase": 0.98, "view": 0.6, "click": 0.75}, ["purchase"])
    return found.withColumn("confidence", F.round("confidence", 6))


@query("""WITH p AS (SELECT l_orderkey % 4 AS k, l_quantity / 50 AS v, l_discount * 10 AS o, l_returnflag AS a, l_linestatus AS b FROM lineitem), g AS (SELECT ['boolean', 'scalar_threshold', 'categorical_match', 'numeric_proximity'][k + 1] AS shape,
CASE k WHEN 0 THEN least(1, v) WHEN 1 THEN CASE WHEN (v >= 0.4) = (o >= 0.4) THEN least(1, 0.5 + abs(v - 0.4)) ELSE 1 - least(1, 0.5 + abs(v - 0.4)) END WHEN 2 THEN least(1, v) ELSE CASE WHEN abs(v - o) <= 0.2 THEN 0.85 ELSE 0.15 END END AS predicted,
CASE k WHEN 0 THEN o > 0.5 WHEN 1 THEN (v >= 0.4) = (o >= 0.4) WHEN 2 THEN (a = 'R') = (b = 'F') ELSE abs(v - o) <= 0.2 END AS actual FROM p)
SELECT shape, count(*) AS n, round(avg(predicted), 6) AS predicted, round(avg(actual::INTEGER), 6) AS actual, round(avg(pow(predicted - actual::INTEGER, 2)), 6) AS brier FROM g GROUP BY 1""")
def calibration_shapes(t):
    """Brier score of each of four outcome shapes."""
    k, value = F.col("l_orderkey") % 4, F.col("l_quantity") / 50
    shape = F.when(k == 0, "boolean").when(k == 1, "scalar_threshold").when(k == 2, "categorical_match").otherwise("numeric_proximity")
    rows = t.lineitem.select(
        shape.alias("shape"), value.alias("value"), F.lit(0.4).alias("threshold"), (F.col("l_discount") * 10).alias("outcome"), F.lit(0.2).alias("tolerance"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("label"),
        F.when(F.col("l_linestatus") == "F", "YES").otherwise("NO").alias("outcome_label"), F.when(k == 2, value).alias("probability"),
    )
    predicted, actual = scores.graded(F.col("shape"))
    graded = rows.select("shape", predicted.alias("p"), actual.alias("a"))
    return graded.groupBy("shape").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("a"), 6).alias("actual"), F.round(F.avg(F.pow(F.col("p") - F.col("a"), 2)), 6).alias("brier"))


@query("""WITH p AS (SELECT page_id, ['linked_team_member', 'linked_portfolio_company', 'linked_social_handle', 'linked_publication', 'same_domain_about_page', 'mentioned_email_domain', 'linked_external_press'][page_id % 7 + 1] AS reason, length(html) % 120 / 100.0 AS authority, CASE WHEN page_id % 3 > 0 THEN page_id % 40 END AS age FROM pages)
SELECT page_id, reason, round(CASE reason WHEN 'linked_social_handle' THEN 0.9 WHEN 'linked_publication' THEN 0.6 WHEN 'same_domain_about_page' THEN 0.6 WHEN 'mentioned_email_domain' THEN 0.5 WHEN 'linked_external_press' THEN 0.3 ELSE 1.0 END * greatest(0.05, least(1, authority)) * CASE WHEN age IS NULL THEN 1 ELSE greatest(0.05, 1 / (1 + age / 7)) END, 4)::DOUBLE AS priority FROM p""")
def frontier_reasons(t):
    names = F.array(*map(F.lit, scores.REASONS))
    key = F.col("page_id")
    reason = F.get(names, (key % 7).cast("int"))
    rows = t.pages.select("page_id", reason.alias("reason"), (F.length("html") % 120 / 100.0).alias("authority"), F.when(key % 3 > 0, key % 40).alias("age"))
    return rows.select("page_id", "reason", scores.frontier(F.col("reason"), F.col("authority"), F.col("age")).alias("priority"))
