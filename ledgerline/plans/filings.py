"""Filings that Spark writes from the given tables, in the forms' own structure, and reads again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import filings, layouts
from .registry import query


def _joined(parts: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """key, body: the texts of a key's few lines in order (an order has seven at most)."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), text.alias("text")))).alias("all")).select(key, F.array_join(F.transform("all", lambda x: x["text"]), "").alias("body"))


def _parsed(rows: DataFrame, kind: str, key: str, html: Column) -> DataFrame:
    return filings.parse(rows.select(key, html.alias("html"), F.lit(None).cast("string").alias("filer_name")), kind)


def _tag(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


@query("""SELECT l_orderkey, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, 'PART & ' || l_partkey AS issuer_name, l_returnflag AS title_of_class, CAST(l_linenumber AS DOUBLE) * 1000 AS value_usd, floor(l_quantity) AS shares, CASE WHEN l_returnflag = 'R' THEN 'PUT' END AS put_call,
CASE WHEN l_linestatus = 'O' THEN 'SOLE' ELSE 'DFND' END AS discretion, CAST(l_suppkey AS DOUBLE) AS voting_sole FROM lineitem""")
def filing_holdings(t):
    """13F information tables, one of each order, and the positions read from them."""
    row = F.concat(
        F.lit("<n1:infoTable>"), _tag("n1:nameOfIssuer", F.concat(F.lit("PART &amp; "), F.col("l_partkey").cast("string"))), _tag("n1:titleOfClass", F.col("l_returnflag")), _tag("n1:cusip", F.lpad(F.col("l_partkey").cast("string"), 9, "0")), _tag("n1:value", F.col("l_linenumber")),
        _tag("n1:shrsOrPrnAmt", _tag("n1:sshPrnamt", F.floor("l_quantity"))), F.when(F.col("l_returnflag") == "R", _tag("n1:putCall", "Put")).otherwise(""), _tag("n1:investmentDiscretion", F.when(F.col("l_linestatus") == "O", "SOLE").otherwise("DFND")),
        _tag("n1:votingAuthority", _tag("n1:Sole", F.col("l_suppkey"))), F.lit("</n1:infoTable>"),
    )
    tables = _joined(t.lineitem, "l_orderkey", "l_linenumber", row)
    parsed = _parsed(tables, "13f", "l_orderkey", F.concat(F.lit('<n1:informationTable xmlns:n1="http://t.example/n1">'), F.col("body"), F.lit("</n1:informationTable>")))
    return filings.listed(parsed, ["l_orderkey"], "holdings").select("l_orderkey", "cusip", "issuer_name", "title_of_class", "value_usd", "shares", "put_call", "discretion", "voting_sole")


@query("""SELECT c_custkey, c_name AS issuer_name, c_mktsegment AS industry_group, round(c_acctbal) AS total_offering, CAST(c_nationkey AS BIGINT) AS investors, CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP) AS first_sale, c_custkey % 3 = 0 AS is_amendment,
CAST(1990 + c_nationkey AS INTEGER) AS year_of_incorporation, 'MEMBER ' || c_custkey AS person, CASE WHEN c_custkey % 2 = 0 THEN 'Director' ELSE 'Manager' END AS role FROM customer""")
def filing_offerings(t):
    """Form D as labelled lines and a table of persons."""
    key = F.col("c_custkey").cast("string")
    dollars = F.round("c_acctbal").cast("long")
    html = F.concat(
        F.lit("<html><p>Entity Name of Issuer:</p><b>"), F.col("c_name"), F.lit("</b><table><tr><td>Industry Group</td><td>"), F.col("c_mktsegment"), F.lit("</td></tr><tr><td>Total Offering Amount</td><td>"),
        F.when(dollars < 0, F.concat(F.lit("($"), F.format_number(-dollars, 0), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(dollars, 0))), F.lit("</td></tr></table><p>Total Number of Investors: "), F.col("c_nationkey").cast("string"),
        F.lit("</p><p>Date of First Sale: "), F.date_format(F.date_add(F.lit("2020-01-01"), (F.col("c_custkey") % 1000).cast("int")), "MM/dd/yyyy"), F.lit("</p><div>Amendment: "), F.when(F.col("c_custkey") % 3 == 0, "Yes").otherwise("No"),
        F.lit("</div><p>Year of Incorporation: "), (F.col("c_nationkey") + 1990).cast("string"), F.lit("</p><table><tr><th>Name</th><th>Relationship</th></tr><tr><td>MEMBER "), key, F.lit("</td><td>"), F.when(F.col("c_custkey") % 2 == 0, "Director").otherwise("Manager"), F.lit("</td></tr></table></html>"),
    )
    parsed = _parsed(t.customer, "form_d", "c_custkey", html)
    parsed = parsed.withColumn("first_sale", F.col("first_sale").cast("timestamp"))
    fields = ["issuer_name", "industry_group", "total_offering", "investors", "first_sale", "is_amendment", "year_of_incorporation"]
    return filings.listed(parsed, ["c_custkey", *fields], "related_persons").select("c_custkey", *fields, F.col("name").alias("person"), "role")


@query("""SELECT o_orderkey, 'Adviser ' || o_custkey AS adviser_name, CAST(o_orderkey AS VARCHAR) AS adviser_crd, CAST(o_custkey AS DOUBLE) AS total_aum, 'Fund ' || l_linenumber || ' of ' || l_suppkey AS fund_name, '805-' || l_partkey AS fund_id, lower(l_linestatus) || '_fund' AS fund_type,
round(l_extendedprice) AS gross_asset_value, CASE WHEN l_returnflag <> 'N' THEN 'Bank ' || l_returnflag END AS custodian FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def filing_funds(t):
    """ADV with a schedule of private funds, one of each order."""
    cell = lambda c: F.concat(F.lit("<td><p>"), c, F.lit("</p></td>"))
    name = F.concat(F.lit("Fund "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))
    row = F.concat(F.lit("<tr>"), cell(name), cell(F.concat(F.lit("805-"), F.col("l_partkey").cast("string"))), cell(F.concat(F.col("l_linestatus"), F.lit(" fund"))), cell(F.concat(F.lit("$"), F.format_number(F.round("l_extendedprice").cast("long"), 0))), cell(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Bank "), F.col("l_returnflag"))).otherwise("")), F.lit("</tr>"))
    schedules = _joined(t.lineitem, "l_orderkey", "l_linenumber", row).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    html = F.concat(
        F.lit("<h1>Adviser "), F.col("o_custkey").cast("string"), F.lit("</h1><table><tr><td>CRD Number</td><td>"), F.col("l_orderkey").cast("string"), F.lit("</td></tr><tr><td>Regulatory Assets Under Management</td><td>$"), F.format_number("o_custkey", 0),
        F.lit("</td></tr></table><table><tr><th>Private Fund Name</th><th>Identification Number</th><th>Type of Fund</th><th>Gross Asset Value</th><th>Custodian</th></tr>"), F.col("body"), F.lit("</table>"),
    )
    parsed = _parsed(schedules, "adv", "l_orderkey", html).withColumnRenamed("l_orderkey", "o_orderkey")
    return filings.listed(parsed, ["o_orderkey", "adviser_name", "adviser_crd", "total_aum"], "funds").select("o_orderkey", "adviser_name", "adviser_crd", "total_aum", "fund_name", "fund_id", "fund_type", "gross_asset_value", "custodian")


@query("""SELECT l_orderkey, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS owner_cik, l_orderkey % 2 = 0 AS is_director, l_orderkey % 5 = 0 AS is_other, CAST(l_shipdate AS TIMESTAMP) AS traded, l_returnflag AS code, CAST(l_quantity AS DOUBLE) AS shares, CAST(l_linenumber AS DOUBLE) AS price FROM lineitem""")
def filing_trades(t):
    """Form 4 with a trade for each line of an order."""
    value = lambda name, c: _tag(name, _tag("value", c))
    row = _tag("nonDerivativeTransaction", F.concat(value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), _tag("transactionCoding", _tag("transactionCode", F.col("l_returnflag"))), _tag("transactionAmounts", F.concat(value("transactionShares", F.col("l_quantity")), value("transactionPricePerShare", F.col("l_linenumber"))))))
    forms = _joined(t.lineitem, "l_orderkey", "l_linenumber", row)
    relation = _tag("reportingOwnerRelationship", F.concat(_tag("isDirector", F.when(F.col("l_orderkey") % 2 == 0, "1").otherwise("0")), _tag("isOther", F.when(F.col("l_orderkey") % 5 == 0, "true").otherwise("false"))))
    html = _tag("ownershipDocument", F.concat(_tag("reportingOwner", F.concat(_tag("reportingOwnerId", _tag("rptOwnerCik", F.col("l_orderkey"))), relation)), _tag("nonDerivativeTable", F.col("body"))))
    parsed = _parsed(forms, "form_4", "l_orderkey", html)
    keep = ["l_orderkey", "owner_cik", "is_director", "is_other"]
    return filings.listed(parsed, keep, "trades").select(*keep, F.col("traded").cast("timestamp").alias("traded"), "code", "shares", "price")


@query("""SELECT l_orderkey, '1998-12-01' AS as_of, l_linenumber AS number, 'Fund ' || l_suppkey || ' of ' || l_returnflag AS fund, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * floor(l_quantity) * 1000 AS committed, l_partkey * 1000.0 AS value FROM lineitem""")
def disclosure_tables(t):
    """Text tables of fixed layout, one of each order, whose columns are found."""
    quantity = F.format_number(F.floor("l_quantity"), 0)
    signed = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("("), quantity, F.lit(")"))).otherwise(quantity)
    fund = F.concat(F.lit("Fund "), F.col("l_suppkey").cast("string"), F.lit(" of "), F.col("l_returnflag"))
    row = F.concat(F.rpad(F.col("l_linenumber").cast("string"), 5, " "), F.rpad(fund, 30, " "), F.lpad(signed, 14, " "), F.lpad(F.concat(F.lit("$"), F.format_number("l_partkey", 0)), 16, " "), F.lit("\n"))
    bodies = _joined(t.lineitem, "l_orderkey", "l_linenumber", row)
    head = f"Quarterly report\nAs of 1998-12-01  (in thousands)\n\n{'No':5}{'Fund Name':30}{'Committed':>14}{'Market Value':>16}\n"
    found = layouts.find_tables(bodies.select("l_orderkey", F.concat(F.lit(head), F.col("body"), F.lit("\nEnd of table\n")).alias("text")), "l_orderkey", "text")
    return found.select("l_orderkey", "as_of", layouts.cell("no").cast("int").alias("number"), layouts.cell("fund_name").alias("fund"), layouts.amount("committed").alias("committed"), layouts.amount("market_value").alias("value"))
