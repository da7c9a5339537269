"""Text and keys, identity, scores and facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import jaccard
from ..functions.numbers import clamp, half_life, log_scale
from ..operators import identity, joins, scores
from .registry import query

_MARKS = "translate(%s, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(lower({_MARKS % 'text'}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def text_slug(t):
    return t.documents.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query(r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || ' Holding, Inc.'), '\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|ag|lp|llp)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS company,
regexp_replace(lower(trim(' ' || replace(c_name, '#', '+tag') || '@Mail.Example.com ')), '\+[^@]*@', '@', 'g') AS email FROM customer""")
def canonical_keys(t):
    mail = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("+tag")), F.lit("@Mail.Example.com "))
    return t.customer.select("c_custkey", tx.company_key(F.concat("c_name", F.lit(" Holding, Inc."))).alias("company"), tx.email_key(mail).alias("email"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') AS path,
list_sort(list_filter(string_split(lower(regexp_extract(url, '\?([^#]*)', 1)), '&'), lambda p: p <> '' AND string_split(p, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'utm_name', 'fbclid', 'gclid', 'dclid', 'msclkid', 'yclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'ref_url', '_hsenc', '_hsmi', 'hsctatracking', 'vero_conv', 'vero_id', 'wickedid', 'igshid'))) AS kept FROM pages)
SELECT page_id, host, 'https://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM p""")
def url_canonical(t):
    return t.pages.select("page_id", tx.host(F.col("url")).alias("host"), tx.canonical_url(F.col("url")).alias("url"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1:5], ' ') AS first_links FROM pages""")
def html_extract(t):
    links = tx.anchors(F.col("html"))
    return t.pages.select("page_id", tx.html_title(F.col("html")).alias("title"), F.size(links).cast("long").alias("links"), F.array_join(F.slice(links, 1, 5), " ").alias("first_links"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text(t):
    return t.pages.select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("text_md5"))


_PII = r"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') AS t1 FROM documents),
b AS (SELECT *, regexp_replace(t1, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[ip]', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, '\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?[0-9]{3}-[0-9]{4}', '[phone]', 'g') AS t3 FROM b) """


@query(_PII + r"""SELECT doc_id, len(regexp_extract_all(t0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS email, len(regexp_extract_all(t1, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS ip,
len(regexp_extract_all(t2, '\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?[0-9]{3}-[0-9]{4}')) AS phone, len(regexp_extract_all(t3, '\b[0-9]{16}\b')) AS card FROM c""")
def pii_redact_counts(t):
    return tx.pii_counts(t.documents.select("doc_id", "text"), "text")


@query(_PII + r"SELECT doc_id, md5(regexp_replace(t3, '\b[0-9]{16}\b', '[card]', 'g')) AS redacted_md5 FROM c")
def pii_redacted(t):
    return t.documents.select("doc_id", F.md5(tx.redact_pii(F.col("text"))).alias("redacted_md5"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, left(sha256(source || '|' || lang), 16) AS dedupe_key FROM documents")
def sha_keys(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), F.substring(F.sha2(F.concat_ws("|", "source", "lang"), 256), 1, 16).alias("dedupe_key"))


@query("SELECT c_custkey, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) % 100 AS BIGINT) AS bucket FROM customer")
def fnv_bucket(t):
    return t.customer.select("c_custkey", F.pmod(tx.fnv1a(F.col("c_name")), F.lit(100)).alias("bucket"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN round(o_totalprice) WHEN 1 THEN round(o_totalprice) * 1000 WHEN 2 THEN round(o_totalprice) WHEN 3 THEN (round(o_totalprice) + 0.5) * 1000000 END AS DOUBLE) AS usd FROM orders""")
def money_parse(t):
    """Orders' prices as people write them: with signs, units, thousands marks, or not at all."""
    whole = F.round("o_totalprice").cast("long")
    text, turn = whole.cast("string"), F.col("o_orderkey") % 5
    raw = F.when(turn == 0, F.concat(F.lit("€"), text)).when(turn == 1, F.concat(text, F.lit("k USD"))).when(turn == 2, F.format_number(whole, 0)).when(turn == 3, F.concat(F.lit("$"), text, F.lit(".5m"))).otherwise("N/A")
    return t.orders.select("o_orderkey", tx.money(raw).alias("usd"))


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN true WHEN '2' THEN false WHEN '3' THEN true WHEN '5' THEN true END AS parsed FROM orders")
def bool_parse(t):
    """Orders' priorities in words for yes and no."""
    first = F.left("o_orderpriority", F.lit(1))
    raw = F.when(first == "1", "Yes").when(first == "2", "n").when(first == "3", "1").when(first == "5", " X ").otherwise("maybe")
    return t.orders.select("o_orderkey", tx.parse_bool(raw).alias("parsed"))


@query(r"""WITH m AS (SELECT event_id, 'failed at ''' || event_type || ''' id ' || sha256(CAST(event_id AS VARCHAR)) || ' after ' || CAST(1000 + event_id % 50 AS VARCHAR) || ' ms ' || user_id % 3 AS msg FROM events WHERE event_type = 'error'),
s AS (SELECT event_id, left(regexp_replace(regexp_replace(regexp_replace(msg, '''[^'']*''|"[^"]*"', '<q>', 'g'), '\b[0-9a-f]{16,}\b', '<hex>', 'g'), '[0-9]{2,}', '<n>', 'g'), 400) AS signature FROM m)
SELECT signature, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1""")
def error_signatures(t):
    msg = F.concat(F.lit("failed at '"), "event_type", F.lit("' id "), F.sha2(F.col("event_id").cast("string"), 256), F.lit(" after "), (1000 + F.col("event_id") % 50).cast("string"), F.lit(" ms "), (F.col("user_id") % 3).cast("string"))
    return t.events.filter("event_type = 'error'").groupBy(tx.error_signature(msg).alias("signature")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH f AS (SELECT user_id AS entity, event_type AS predicate, CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 20 AS VARCHAR) AS value, ts FROM events),
m AS (SELECT entity, predicate, value, max(ts) AS o, count(*) AS n FROM f GROUP BY 1, 2, 3)
SELECT entity, predicate, value, n, sha256(entity || '|' || predicate || '|' || value) AS hash, CAST(row_number() OVER (PARTITION BY entity, predicate ORDER BY o DESC, value) = 1 AS INTEGER) AS is_current FROM m""")
def fact_supersede(t):
    value = F.floor(F.get_json_object("props", "$.k").cast("int") / 20).cast("string")
    facts = t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("predicate"), value.alias("value"), "ts")
    return identity.supersede(facts, ["entity", "predicate"], "value", "ts").select("entity", "predicate", "value", "n", "hash", "is_current")


@query("""WITH s AS (SELECT user_id, count(*) AS n, avg(least(1.0, value / 100)) AS c, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1)
SELECT user_id, tags, round(0.5 * least(1.0, n / 120.0) + 0.3 * c + 0.2 * least(1.0, kinds / 3.0), 4) AS quality FROM s""")
def entity_summary(t):
    s = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("c"), F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tags"))
    quality = 0.5 * F.least(F.lit(1.0), F.col("n") / 120.0) + 0.3 * F.col("c") + 0.2 * F.least(F.lit(1.0), F.col("kinds") / 3.0)
    return s.select("user_id", "tags", F.round(quality, 4).alias("quality"))


_PEOPLE = """WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS email, CASE WHEN c_custkey % 11 < 4 THEN 'in/' || c_custkey END AS linkedin, CASE WHEN c_custkey % 5 < 2 THEN CAST(c_custkey AS VARCHAR) END AS phone,
c_mktsegment || c_custkey % 10 || '|' || c_nationkey AS name_firm, c_custkey % 10 || '|' || c_nationkey AS name_city FROM customer),
k AS (SELECT s_suppkey AS known, CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, 'Supplier', 'Customer') END AS email, CASE WHEN s_suppkey % 3 > 0 THEN 'in/' || s_suppkey * 7 END AS linkedin, CASE WHEN s_suppkey % 7 < 5 THEN CAST(s_suppkey * 13 AS VARCHAR) END AS phone,
CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END || s_suppkey % 10 || '|' || s_nationkey AS name_firm, s_suppkey % 10 || '|' || s_nationkey AS name_city, s_acctbal AS created FROM supplier) """


@query(_PEOPLE + """, u AS (SELECT id, known, created, 'email' AS key, 1.0 AS score FROM n JOIN k USING (email) UNION ALL SELECT id, known, created, 'linkedin', 0.95 FROM n JOIN k USING (linkedin) UNION ALL SELECT id, known, created, 'phone', 0.9 FROM n JOIN k USING (phone)
UNION ALL SELECT id, known, created, 'name_firm', 0.75 FROM n JOIN k USING (name_firm) UNION ALL SELECT id, known, created, 'name_city', 0.65 FROM n JOIN k USING (name_city))
SELECT id, known, key, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'merge' WHEN score >= 0.6 THEN 'review' ELSE 'new' END AS decision FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, created DESC, known) = 1""")
def identity_cascade(t):
    """All customers against all suppliers."""
    c, s, text = F.col("c_custkey"), F.col("s_suppkey"), lambda x: x.cast("string")
    new = t.customer.select(
        c.alias("id"), F.when(c % 3 == 0, F.col("c_name")).alias("email"), F.when(c % 11 < 4, F.concat(F.lit("in/"), text(c))).alias("linkedin"), F.when(c % 5 < 2, text(c)).alias("phone"),
        F.concat("c_mktsegment", text(c % 10), F.lit("|"), text(F.col("c_nationkey"))).alias("name_firm"), F.concat(text(c % 10), F.lit("|"), text(F.col("c_nationkey"))).alias("name_city"),
    )
    sector = F.when(s % 3 == 0, "BUILDING").when(s % 3 == 1, "MACHINERY").otherwise("FURNITURE")
    known = t.supplier.select(
        s.alias("known"), F.when(s % 2 == 0, F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("email"), F.when(s % 3 > 0, F.concat(F.lit("in/"), text(s * 7))).alias("linkedin"), F.when(s % 7 < 5, text(s * 13)).alias("phone"),
        F.concat(sector, text(s % 10), F.lit("|"), text(F.col("s_nationkey"))).alias("name_firm"), F.concat(text(s % 10), F.lit("|"), text(F.col("s_nationkey"))).alias("name_city"), F.col("s_acctbal").alias("created"),
    )
    found = identity.cascade(new, known, identity.KEYS, "id", "known", "created")
    return found.withColumn("decision", identity.decide(F.col("score")))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS seq, CAST(left(o_orderpriority, 1) AS INTEGER) AS p, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS stage, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS amount FROM orders)
SELECT k, arg_max(stage, (p, seq)) FILTER (stage IS NOT NULL) AS stage, arg_max(amount, (p, seq)) FILTER (amount IS NOT NULL) AS amount, count(*) AS n_sources FROM r GROUP BY 1""")
def field_merge(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("stage"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("amount"))
    return identity.merge_fields(rows, "k", ["stage", "amount"], F.col("p"), "at")


@query("""SELECT sha256(o_custkey || '|' || o_orderpriority || '|' || strftime(o_orderdate, '%Y')) AS key, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def dedupe_key_groups(t):
    key = F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy")), 256)
    return t.orders.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""WITH r AS (SELECT l_orderkey AS deal, l_quantity AS amount, CAST(l_shipdate AS DATE) AS day, l_tax AS authority, l_suppkey AS source FROM lineitem),
g AS (SELECT deal, arg_max((amount, day), (authority, -(day - DATE '1970-01-01'), source, amount)) AS b, count(DISTINCT source) AS sources, min(amount) AS lo, max(amount) AS hi, min(day) AS d0, max(day) AS d1 FROM r GROUP BY 1)
SELECT deal, b[1] AS amount, CAST(b[2] AS VARCHAR) AS day, sources, CASE WHEN greatest(hi - b[1], b[1] - lo) > 0.05 * abs(b[1]) OR greatest(d1 - b[2], b[2] - d0) > 14 THEN 'disputed' WHEN sources >= 2 THEN 'corroborated' ELSE 'single' END AS status,
round(least(0.99, 0.6 + 0.1 * (sources - 1)), 4)::DOUBLE AS confidence FROM g""")
def reconcile_sources(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("deal"), F.col("l_quantity").alias("amount"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_tax").alias("authority"), F.col("l_suppkey").alias("source"))
    return identity.reconcile(rows, ["deal"], "amount", "day", "authority", "source", 0.6)


@query("""WITH p AS (SELECT left(p_name, 3) || p_brand AS b, p_name, min(p_partkey) AS rep FROM part GROUP BY 1, 2), s AS (SELECT x.rep AS a, y.rep AS b, 1 - levenshtein(lower(x.p_name), lower(y.p_name)) / greatest(length(x.p_name), length(y.p_name), 1) AS score FROM p x JOIN p y ON x.b = y.b AND x.rep < y.rep)
SELECT a, b, round(score, 4) AS score FROM s WHERE score >= 0.8 UNION ALL SELECT rep, p_partkey, 1.0 FROM part JOIN p ON p.b = left(part.p_name, 3) || p_brand AND p.p_name = part.p_name WHERE p_partkey <> rep""")
def name_match_fuzzy(t):
    found = identity.fuzzy_names(t.part, "p_partkey", F.concat(F.substring("p_name", 1, 3), F.col("p_brand")), "p_name", 0.8)
    return found.withColumn("score", F.round("score", 4))


_ACCOUNT = """WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
p AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.0 WHEN c_mktsegment = 'AUTOMOBILE' THEN 0.5 ELSE 0.0 END AS industry, greatest(0.0, 1 - abs(c_nationkey - 12) * 0.1) AS geo,
least(1.0, ln(1 + coalesce(n, 0)) / ln(1 + 20.0)) AS activity, CASE WHEN n IS NULL THEN 0.0 ELSE pow(0.5, date_diff('day', CAST(last AS DATE), DATE '2001-08-02') / 365.0) END AS recency,
least(1.0, greatest(0.0, coalesce(mean, 0) / 400000)) AS size FROM customer LEFT JOIN o ON o_custkey = c_custkey) """


def _account_parts(t):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.avg("o_totalprice").alias("mean"))
    joined = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    segment = F.col("c_mktsegment")
    parts = {
        "industry": (F.when(segment.isin("BUILDING", "MACHINERY"), 1.0).when(segment == "AUTOMOBILE", 0.5).otherwise(0.0), 0.3),
        "geo": (scores.closeness(F.col("c_nationkey") - 12, 0.1), 0.15),
        "activity": (log_scale(F.coalesce("n", F.lit(0)), 20), 0.25),
        "recency": (F.when(F.col("n").isNull(), 0.0).otherwise(half_life(F.datediff(F.lit("2001-08-02").cast("date"), F.col("last").cast("date")), 365)), 0.2),
        "size": (clamp(F.coalesce("mean", F.lit(0.0)) / 400000), 0.1),
    }
    return joined, parts


@query(_ACCOUNT + "SELECT c_custkey, round(0.3 * industry + 0.15 * geo + 0.25 * activity + 0.2 * recency + 0.1 * size, 3) AS score FROM p")
def account_fit(t):
    joined, parts = _account_parts(t)
    return joined.select("c_custkey", scores.weighted(parts).alias("score"))


@query(_ACCOUNT + """, e AS (SELECT c_custkey, unnest([{'v': round(0.3 * industry, 9), 'n': 'industry'}, {'v': round(0.15 * geo, 9), 'n': 'geo'}, {'v': round(0.25 * activity, 9), 'n': 'activity'}, {'v': round(0.2 * recency, 9), 'n': 'recency'}, {'v': round(0.1 * size, 9), 'n': 'size'}]) AS e FROM p),
r AS (SELECT c_custkey, e.n AS n, row_number() OVER (PARTITION BY c_custkey ORDER BY e.v DESC, e.n) AS i FROM e WHERE e.v > 0) SELECT c_custkey, string_agg(n, ',' ORDER BY i) AS reasons FROM r WHERE i <= 3 GROUP BY 1""")
def account_reasons(t):
    joined, parts = _account_parts(t)
    rounded = {n: (F.round(c * w, 9), 1.0) for n, (c, w) in parts.items()}
    return joined.select("c_custkey", scores.reasons(rounded).alias("reasons")).filter("reasons <> ''")


@query(_ACCOUNT + "SELECT c_custkey, round(coalesce(0.25 * activity + CASE WHEN recency > 0.2 THEN 0.2 * recency ELSE 0 END, 0) / (0.25 + CASE WHEN recency > 0.2 THEN 0.2 ELSE 0 END), 4) AS score FROM p")
def lead_quality(t):
    joined, parts = _account_parts(t)
    recency, w = parts["recency"]
    return joined.select("c_custkey", scores.weighted_present({"activity": parts["activity"], "recency": (F.when(recency > 0.2, recency), w)}).alias("score"))


@query("""WITH h AS (SELECT user_id, event_type AS method, max(least(0.9, 0.5 + value / 400)) AS c FROM events GROUP BY 1, 2) SELECT user_id, round(least(0.99, max(c) + 0.07 * (count(*) - 1)), 4) AS confidence, count(*) AS methods, least(0.99, max(c) + 0.07 * (count(*) - 1)) >= 0.95 AS auto_link FROM h GROUP BY 1""")
def hit_fusion(t):
    best = t.events.groupBy("user_id", "event_type").agg(F.max(F.least(F.lit(0.9), 0.5 + F.col("value") / 400)).alias("c"))
    fused = F.least(F.lit(0.99), F.max("c") + 0.07 * (F.count("*") - 1))
    return best.groupBy("user_id").agg(fused.alias("f"), F.count("*").alias("methods")).select("user_id", F.round("f", 4).alias("confidence"), "methods", (F.col("f") >= 0.95).alias("auto_link"))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, avg(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_partkey, count(*) AS hosts, max(v) - min(v) AS spread, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1)
SELECT l_partkey, round(least(1.0, 0.3 + 0.15 * least(hosts, 4) + CASE WHEN spread <= 0.05 THEN 0.2 ELSE -0.1 END), 4)::DOUBLE AS verified, hosts FROM g""")
def verified_score(t):
    c = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("v"))
    g = c.groupBy("l_partkey").agg(F.count("*").alias("hosts"), (F.max("v") - F.min("v")).alias("spread"))
    score = F.least(F.lit(1.0), 0.3 + 0.15 * F.least("hosts", F.lit(4)) + F.when(F.col("spread") <= 0.05, 0.2).otherwise(-0.1))
    return g.select("l_partkey", F.round(score, 4).alias("verified"), "hosts")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '/(en|de)/') AND length(html) > 12000 THEN 'article' WHEN contains(html, 'application/ld+json') THEN 'structured' WHEN contains(html, 'og:title') THEN 'shared' WHEN regexp_matches(url, '^https?://m\.') THEN 'mobile' ELSE 'other' END AS class FROM pages""")
def page_class(t):
    url, html = F.col("url"), F.col("html")
    found = F.when(url.rlike("/(en|de)/") & (F.length(html) > 12000), "article").when(html.contains("application/ld+json"), "structured").when(html.contains("og:title"), "shared").when(url.rlike(r"^https?://m\."), "mobile").otherwise("other")
    return t.pages.select("page_id", found.alias("class"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\blicen[sc]e\b') THEN 'legal' WHEN n_chars < 40 THEN 'fragment' WHEN (length(text) - length(replace(text, '|', ''))) * 20 > n_chars THEN 'table' ELSE 'prose' END AS class FROM documents""")
def doc_class(t):
    bars = F.length("text") - F.length(F.replace("text", F.lit("|")))
    found = F.when(F.lower("text").rlike(r"\blicen[sc]e\b"), "legal").when(F.col("n_chars") < 40, "fragment").when(bars * 20 > F.col("n_chars"), "table").otherwise("prose")
    return t.documents.select("doc_id", found.alias("class"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_extract(text, '^[^\n.]*', 0)) AS name FROM documents) SELECT doc_id, CASE WHEN length(name) < 3 THEN 'too short' WHEN regexp_matches(name, '[*$&%|]') THEN 'symbols' WHEN name = upper(name) THEN 'shouting' WHEN regexp_matches(name, '[0-9]{4,}') THEN 'digits' END AS garbage FROM n""")
def garbage_names(t):
    from ..operators.search import first_failure

    name = F.trim(F.regexp_extract("text", r"^[^\n.]*", 0))
    checks = [("too short", F.length("n") < 3), ("symbols", F.col("n").rlike(r"[*$&%|]")), ("shouting", F.col("n") == F.upper("n")), ("digits", F.col("n").rlike("[0-9]{4,}"))]
    return t.documents.select("doc_id", name.alias("n")).select("doc_id", first_failure(checks).alias("garbage"))


@query()
def span_verify(t):
    """Whole benchmark texts, as claims and spans, against all documents."""
    from ..operators.search import verify_spans

    found = verify_spans(t.benchmark.select("item_id", F.col("text").alias("claim"), F.col("text").alias("span")), t.documents)
    return found.withColumn("share", F.round("share", 4))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, len(regexp_extract_all(html, '<a href="')) AS links, len(string_split(url, '/')) - 3 AS depth FROM pages), n AS (SELECT *, count(*) OVER (PARTITION BY host) AS seen FROM h)
SELECT page_id, round(pow(0.8, depth) * (1 + ln(1 + links)) / (1 + 0.1 * seen), 4) AS priority FROM n""")
def frontier_priority(t):
    h = t.pages.select("page_id", tx.host(F.col("url")).alias("host"), F.regexp_count("html", F.lit('<a href="')).alias("links"), (F.size(F.split("url", "/")) - 3).alias("depth"))
    seen = F.count("*").over(Window.partitionBy("host"))
    return h.select("page_id", F.round(F.pow(F.lit(0.8), F.col("depth")) * (1 + F.log1p(F.col("links").cast("double"))) / (1 + 0.1 * seen), 4).alias("priority"))


@query(r"""WITH f AS (SELECT c.conv_id, c.role, avg(length(text)) AS len, avg(length(text) - length(replace(text, ',', ''))) AS commas, avg(length(text) - length(replace(text, '.', ''))) AS dots, avg(len(string_split(text, ' '))) AS words FROM conversations c GROUP BY 1, 2)
SELECT a.conv_id, round((a.len * b.len + a.commas * b.commas + a.dots * b.dots + a.words * b.words) / (sqrt(a.len * a.len + a.commas * a.commas + a.dots * a.dots + a.words * a.words) * sqrt(b.len * b.len + b.commas * b.commas + b.dots * b.dots + b.words * b.words)), 6) AS cosine
FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'""")
def stylometry_cosine(t):
    marks = lambda m: F.avg(F.length("text") - F.length(F.replace("text", F.lit(m))))
    f = t.conversations.groupBy("conv_id", "role").agg(F.array(F.avg(F.length("text")), marks(","), marks("."), F.avg(F.size(F.split("text", " ")))).alias("v"))
    sides = f.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("v"))).alias("a"), F.max(F.when(F.col("role") == "assistant", F.col("v"))).alias("b")).filter("a is not null and b is not null")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return sides.select("conv_id", F.round(dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))), 6).alias("cosine"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_size FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(0.7 * len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) + 0.3 * greatest(0.0, 1 - abs(a.p_size - b.p_size) * 0.1), 4) AS fit FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""")
def persona_fit(t):
    p = t.part.select("p_partkey", F.split("p_name", " ").alias("w"), "p_size")
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("w2"), F.col("p_size").alias("size2"))
    fit = 0.7 * jaccard(F.col("w"), F.col("w2")) + 0.3 * scores.closeness(F.col("p_size") - F.col("size2"), 0.1)
    return p.join(following, "p_partkey").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), F.round(fit, 4).alias("fit"))


@query("""WITH s AS (SELECT user_id, ts, sha256(event_type || CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 50 AS VARCHAR)) AS h, event_id FROM events), l AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT event_id, user_id FROM l WHERE before IS NOT NULL AND before <> h""")
def change_detection(t):
    from ..operators.sequences import changed

    fingerprint = F.sha2(F.concat("event_type", F.floor(F.get_json_object("props", "$.k").cast("int") / 50).cast("string")), 256)
    return changed(t.events.withColumn("h", fingerprint), ["user_id"], ["ts", "event_id"], "h").select("event_id", "user_id")


@query("SELECT kind, conv_id FROM (SELECT CASE WHEN turn > 4 THEN 'long' ELSE 'short' END AS kind, conv_id FROM (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1))")
def conversation_kind(t):
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return last.select(F.when(F.col("turn") > 4, "long").otherwise("short").alias("kind"), "conv_id")


@query("""SELECT v.vec_id, q.vec_id AS match, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine, CASE WHEN list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.85 THEN 'merge' ELSE 'review' END AS decision
FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, q.vec_id) = 1""")
def vector_resolve(t):
    best = joins.vector_top_k(t.embeddings, t.embeddings, 1, cell=32_768)
    return best.select(F.col("query").alias("vec_id"), F.col("id").alias("match"), F.round("cosine", 6).alias("cosine"), F.when(F.col("cosine") >= 0.85, "merge").otherwise("review").alias("decision"))
