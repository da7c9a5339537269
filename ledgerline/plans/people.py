"""Personal data of nine kinds, and movements between snapshots of teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import movements as moves
from .registry import query


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _pii_sql() -> str:
    """Each kind's count, and the text after it, one step of WITH a kind."""
    steps, before = ["t0 AS (SELECT doc_id, text AS t FROM documents)"], "t0"
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    digit = f"CAST(reverse({digits})[i + 1] AS INTEGER)"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} ELSE {digit} * 2 % 10 + {digit} // 5 END)) % 10 = 0"
    checked = f"list_filter(regexp_extract_all(t, {{p}}), lambda x: length({digits}) BETWEEN 13 AND 19 AND {luhn})"
    names = []
    for i, (kind, (mark, pattern)) in enumerate(pii.KINDS.items(), 1):
        if kind == "person_name":
            break
        if kind == "credit_card":
            steps.append(f"f{i} AS (SELECT *, {checked.format(p=_q(pattern))} AS found FROM {before})")
            steps.append(f"t{i} AS (SELECT * EXCLUDE (t, found), len(found) AS {kind}, list_reduce(list_prepend(t, found), lambda a, x: replace(a, x, '{mark}')) AS t FROM f{i})")
        else:
            steps.append(f"t{i} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, {_q(pattern)})) AS {kind}, regexp_replace(t, {_q(pattern)}, '{mark}', 'g') AS t FROM {before})")
        before = f"t{i}"
        names.append(f"coalesce({kind}, 0) AS {kind}")
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(names)}, md5(t) AS text_md5 FROM {before}"


@query(_pii_sql())
def pii_kinds(t):
    """All kinds but names, whose pattern looks around itself, in all documents."""
    found = pii.redact(t.documents.select("doc_id", "text"), "text", tuple(k for k in pii.KINDS if k != "person_name"))
    return found.withColumn("text_md5", F.md5("text")).drop("text")


@query()
def pii_names(t):
    """Names of persons in all documents."""
    return pii.redact(t.documents.select("doc_id", "text"), "text").select("doc_id", "person_name")


_TITLE = "CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'Managing Partner' WHEN '2-HIGH' THEN ' Partner ' WHEN '3-MEDIUM' THEN 'VP Finance' WHEN '5-LOW' THEN 'Analyst' END"


@query(f"""WITH o AS (SELECT *, year(o_orderdate) * 4 + quarter(o_orderdate) AS period, o_custkey % 40 AS firm FROM orders), s AS (SELECT DISTINCT firm, period FROM o), m AS (SELECT firm, period, o_custkey AS member, nullif(trim({_TITLE}), '') AS title FROM o WHERE NOT ((period + firm) % 9 = 0) GROUP BY 1, 2, 3),
c AS (SELECT s.firm, s.period, count(member) AS n FROM s LEFT JOIN m ON m.firm = s.firm AND m.period = s.period GROUP BY 1, 2),
l AS (SELECT firm, period, n, row_number() OVER w AS seq, lag(n) OVER w AS before, lead(n) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(period) OVER w AS period1 FROM c WINDOW w AS (PARTITION BY firm ORDER BY period)),
x AS (SELECT m.firm, m.period, member, title, n, seq, before, n1, n2, period1, lag(seq) OVER w AS last, lag(title) OVER w AS was, lead(seq) OVER w AS next FROM m JOIN l ON l.firm = m.firm AND l.period = m.period WINDOW w AS (PARTITION BY m.firm, member ORDER BY seq)),
r AS (SELECT unnest([NULL, 'Managing Partner', 'Partner', 'VP Finance', 'Analyst']) AS title, unnest([NULL, 10, 8, 7, 3]) AS rank)
SELECT firm, member, 'joined' AS movement, period, NULL AS from_title, title AS to_title FROM x WHERE before > 0 AND n > 0 AND (last IS NULL OR last <> seq - 1)
UNION ALL SELECT firm, member, 'left', period1, title, NULL FROM x WHERE n1 > 0 AND n2 > 0 AND (next IS NULL OR next > seq + 2)
UNION ALL SELECT x.firm, x.member, CASE WHEN b.rank > a.rank THEN 'promoted' ELSE 'title_change' END, x.period, x.was, x.title FROM x LEFT JOIN r a ON a.title = x.was LEFT JOIN r b ON b.title = x.title WHERE before > 0 AND n > 0 AND last = seq - 1 AND was IS DISTINCT FROM x.title""")
def team_movements(t):
    """Customers stand for people of forty firms, quarters for snapshots, of which every ninth of a firm failed."""
    o = t.orders.select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("at"), (F.col("o_custkey") % 40).alias("firm"), F.col("o_custkey").alias("member"), "o_orderpriority")
    held = o.filter((F.col("at") + F.col("firm")) % 9 != 0).groupBy("firm", "at", "member").agg(F.expr(_TITLE).alias("title"))
    return moves.movements(held, o.select("firm", "at"), "firm", "at", "member", "title").withColumnRenamed("at", "period")


@query(f"""WITH o AS (SELECT *, year(o_orderdate) * 4 + quarter(o_orderdate) AS period, o_custkey % 60 AS firm FROM orders), m AS (SELECT firm, period, o_custkey AS member, {_TITLE} AS title FROM o GROUP BY 1, 2, 3), l AS (SELECT firm, max(period) AS period FROM m GROUP BY 1),
p AS (SELECT l.firm, count(*) FILTER (regexp_matches(title, '(?i)\\bpartner\\b')) AS partner_count FROM l JOIN m ON m.firm = l.firm AND m.period = l.period GROUP BY 1), f AS (SELECT s_suppkey % 70 AS firm, s_suppkey AS filed, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 8 END AS eligible FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 70 ORDER BY s_suppkey DESC) = 1)
SELECT firm, CASE WHEN partner_count > 0 AND eligible >= partner_count THEN 'broad' WHEN partner_count > 0 AND eligible < ceil(partner_count / 2) THEN 'concentrated' ELSE 'unknown' END AS breadth, partner_count, eligible FROM p FULL JOIN f USING (firm)""")
def carry_breadth(t):
    """Customers' last quarters stand for snapshots of sixty firms, suppliers for filings of seventy."""
    o = t.orders.select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("period"), (F.col("o_custkey") % 60).alias("firm"), F.col("o_custkey").alias("member"), "o_orderpriority")
    members = o.groupBy("firm", "period", "member").agg(F.expr(_TITLE).alias("title"))
    filed = t.supplier.select((F.col("s_suppkey") % 70).alias("firm"), F.col("s_suppkey").alias("filed"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey") % 8).alias("eligible"))
    return moves.carry_breadth(members, o.select("firm", "period"), filed, "firm", "period", "title", "filed", "eligible")
