"""Each form's fields from a small document of its structure."""

import datetime

import pytest

from ledgerline.sources import filings

DOCUMENTS = {
    "adv": """<html><script>var x = "<td>CRD Number</td>";</script><h1>Northwind Capital Management</h1><!-- <p>CRD: 1</p> -->
<table><tr><td>CRD Number</td><td>104518</td></tr><tr><td><p>SEC File Number:</p></td><td><p>801-12345</p></td></tr><tr><td>Regulatory Assets Under Management</td><td>$1,234,567,890</td></tr><tr><th>Total Number of Employees</th><td>42</td></tr>
<tr><td>Principal Office</td><td>Menlo Park, United States</td></tr></table><p>Website: <a class="x" href="https://northwind.example/a">our site</a></p>
<table><tr><th>Private Fund Name</th><th>Identification Number</th><th>Type of Fund</th><th>Gross Asset Value</th><th>Custodian</th><th>Master/Feeder</th><th>Country</th></tr>
<tr><td>Northwind Growth II, L.P.</td><td>805-1000000001</td><td>Private Equity Fund</td><td>$250,000,000</td><td>First Bank, N.A.</td><td></td><td>Cayman Islands</td></tr>
<tr><td>Northwind Venture &amp; Seed</td><td>805-1000000002</td><td>Venture Capital Fund</td><td>9,500,000</td><td></td><td>Feeder of Master I</td><td>Delaware</td></tr><tr><td colspan="7">End</td></tr></table>
<table><tr><th>Full Legal Name</th><th>Title or Status</th><th>Ownership %</th></tr><tr><td>DOE, JANE A</td><td>MANAGER</td><td>75%</td></tr><tr><td>ROE, RICHARD</td><td>MEMBER</td><td></td></tr></table></html>""",
    "form_d": """<edgarSubmission><primaryIssuer><cik>1790</cik><entityName>Widget Inc</entityName><jurisdictionOfInc>DELAWARE</jurisdictionOfInc><entityType>Corporation</entityType><yearOfInc><value>2019</value></yearOfInc></primaryIssuer>
<relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Ann</firstName><lastName>Poe</lastName></relatedPersonName><relatedPersonAddress><street1>1 Main</street1><city>Reno</city><stateOrCountry>NV</stateOrCountry></relatedPersonAddress>
<relatedPersonRelationshipList><relationship>Director</relationship><relationship>Promoter</relationship></relatedPersonRelationshipList></relatedPersonInfo></relatedPersonsList>
<offeringData><industryGroup><industryGroupType>Biotechnology</industryGroupType></industryGroup><typeOfFiling><newOrAmendment><isAmendment>true</isAmendment></newOrAmendment><dateOfFirstSale><value>2021-03-15</value></dateOfFirstSale></typeOfFiling>
<federalExemptionsExclusions><item>06b</item><item>3C.7</item></federalExemptionsExclusions><minimumInvestmentAccepted>1000</minimumInvestmentAccepted><offeringSalesAmounts><totalOfferingAmount>5000000</totalOfferingAmount><totalAmountSold>3500000</totalAmountSold>
<totalRemaining>Indefinite</totalRemaining></offeringSalesAmounts><investors><totalNumberAlreadyInvested>12</totalNumberAlreadyInvested></investors></offeringData></edgarSubmission>""",
    "form_d_html": """<p>Entity Name of Issuer:</p><b>Gadget LLC</b><p>Jurisdiction of Incorporation: NEVADA</p><p>Year of Incorporation: 2001</p><p>Industry Group: Other</p><p>Total Offering Amount $7,000,000</p><p>Total Amount Sold: $500</p>
<p>Date of First Sale: 03/15/2021</p><p>Is this offering an amendment? No</p><table><tr><td>Name</td><td>Relationship</td><td>Address</td></tr><tr><td>Lee Moe</td><td>Executive Officer</td><td>2 Side St, Elko</td></tr></table>""",
    "13f": """<XML><ns1:informationTable xmlns:ns1="http://x.example/t"><ns1:infoTable><ns1:nameOfIssuer>ALPHA CO</ns1:nameOfIssuer><ns1:titleOfClass>COM</ns1:titleOfClass><ns1:cusip>03783310a</ns1:cusip><ns1:value>1500</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>10000</ns1:sshPrnamt>
<ns1:sshPrnamtType>PRN</ns1:sshPrnamtType></ns1:shrsOrPrnAmt><ns1:investmentDiscretion>SOLE</ns1:investmentDiscretion><ns1:votingAuthority><ns1:Sole>10000</ns1:Sole><ns1:Shared>0</ns1:Shared><ns1:None>5</ns1:None></ns1:votingAuthority></ns1:infoTable>
<ns1:infoTable><ns1:nameOfIssuer>BETA &amp; SONS</ns1:nameOfIssuer><ns1:cusip>123456789</ns1:cusip><ns1:value>1,500</ns1:value><ns1:putCall>Put</ns1:putCall></ns1:infoTable></ns1:informationTable></XML>""",
    "schedule_13": """<table><tr><td>Name of Reporting Person</td><td>Big Holder LP</td></tr><tr><td>Name of Issuer</td><td>Target Corp</td></tr></table><p>Aggregate Amount Beneficially Owned: 1,200,000 shares</p><p>Percent of Class: 8.4 %</p>
<p>Date of Event: 2022-05-01</p><p>Purpose of Transaction: Investment only</p>""",
    "form_4": """<ownershipDocument><issuer><issuerCik>777</issuerCik><issuerName>Target Corp</issuerName><issuerTradingSymbol>TGT</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>12345</rptOwnerCik><rptOwnerName>DOE JANE</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>false</isOfficer><isOther>true</isOther><officerTitle>Chair</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2023-02-03</value></transactionDate>
<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>100.5</value></transactionShares><transactionPricePerShare><value>12.25</value></transactionPricePerShare></transactionAmounts>
<ownershipNature><directOrIndirectOwnership><value>D</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction><nonDerivativeTransaction><transactionDate><value>2023-02-04</value></transactionDate></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>""",
    "s1": """<h2>Newco Holdings</h2><p>Proposed Maximum Aggregate Offering Price: $100,000,000</p><p>Trading Symbol: NEWC</p><table><tr><th>Underwriter</th><th>Number of Shares</th></tr><tr><td>First Securities Inc.</td><td>100</td></tr><tr><td>Second &amp; Co.</td><td>50</td></tr>
<tr><td>First Securities Inc.</td><td>1</td></tr><tr><td>Total</td><td>151</td></tr></table>""",
    "8k": """<p>Date of Report: January 5, 2024</p><p>Item 2.01. Completion of a purchase</p><p>We bought it.</p><p>All of it.</p><p>Item 9.99 Something Quite Different</p><p>Item 2.01 again</p><p>later</p>""",
    "10k": """<p>For the fiscal year ended: December 31, 2020</p><table><tr><td>Total revenues</td><td>$900,000</td></tr><tr><td>Net income</td><td>(12,000)</td></tr><tr><td>Total assets</td><td>3,000,000</td></tr></table>
<table><tr><th>Name and Principal Position</th><th>Position</th><th>Total ($)</th></tr><tr><td>Jane Doe</td><td>Chief Executive Officer</td><td>450,000</td></tr></table>""",
    "pf": """<p>CRD #: 99887</p><p>Total Regulatory Assets Under Management: $5,000</p><p>Fund Name: Alpha One LP</p><p>Identification Number: 805-1</p><p>Fund Type: Hedge Fund</p><p>Gross Asset Value: $700</p><p>Net Asset Value: $650</p><p>Fund Name: Beta</p><p>Gross Asset Value: $1</p>""",
}
TYPES = {"adv": "Form ADV", "form_d": "D/A", "form_d_html": "Form D", "13f": "13F-HR/A", "schedule_13": "SC 13G/A", "form_4": "4", "s1": "S-1/A", "8k": "8-K", "10k": "10-K405", "pf": "PF"}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, TYPES[k], html, f"Filer {k}") for k, html in DOCUMENTS.items()] + [("empty", "D", "", None), ("null", "PF", None, None), ("broken", "13F-HR", "<informationTable><infoTable><cusip>1</infoTable>", "x"), ("other", "EFFECT", "<p>x</p>", None), ("def", "DEF 14A", "<p>x</p>", None)]
    frame = spark.createDataFrame(rows, "id string, form_type string, html string, filer_name string")
    return {kind: {r.id: r for r in table.collect()} for kind, table in filings.parse_all(frame).items()}


def test_each_form_goes_to_its_parser(parsed):
    expected = {k: {k} for k in DOCUMENTS if k != "form_d_html"} | {"form_d": {"form_d", "form_d_html", "empty"}, "13f": {"13f", "broken"}, "pf": {"pf", "null"}, "10q": set()}
    assert {kind: set(rows) for kind, rows in parsed.items()} == expected
    assert all(v in (None, False, []) for k, v in parsed["form_d"]["empty"].asDict().items() if k not in ("id", "form_type"))
    assert all(v in (None, []) for k, v in parsed["pf"]["null"].asDict().items() if k not in ("id", "form_type"))
    assert parsed["13f"]["broken"].holdings == [] and parsed["13f"]["broken"].total_value == 0


def test_advisers_and_funds(parsed):
    r = parsed["adv"]["adv"]
    assert (r.adviser_crd, r.adviser_sec_no, r.adviser_name, r.total_aum, r.employees, r.city, r.country, r.website) == ("104518", "801-12345", "Northwind Capital Management", 1234567890.0, 42, "Menlo Park", "United States", "https://northwind.example/a")
    assert [(f.fund_name, f.fund_id, f.fund_type, f.gross_asset_value, f.custodian, f.master_feeder, f.state_country) for f in r.funds] == [
        ("Northwind Growth II, L.P.", "805-1000000001", "private_equity_fund", 250e6, "First Bank, N.A.", None, "Cayman Islands"),
        ("Northwind Venture & Seed", "805-1000000002", "venture_capital_fund", 9.5e6, None, "Feeder of Master I", "Delaware"),
    ]
    assert [(p.name, p.role, p.share) for p in r.control_persons] == [("DOE, JANE A", "MANAGER", 75.0), ("ROE, RICHARD", "MEMBER", None)]
    p = parsed["pf"]["pf"]
    assert (p.adviser_crd, p.total_aum) == ("99887", 5000.0) and [(f.fund_name, f.fund_id, f.fund_type, f.gross_asset_value, f.net_asset_value) for f in p.funds] == [("Alpha One LP", "805-1", "hedge_fund", 700.0, 650.0), ("Beta", None, None, 1.0, None)]


def test_offerings(parsed):
    d = parsed["form_d"]["form_d"]
    assert (d.issuer_cik, d.issuer_name, d.jurisdiction, d.entity_type, d.year_of_incorporation, d.industry_group) == ("0000001790", "Widget Inc", "DELAWARE", "Corporation", 2019, "Biotechnology")
    assert (d.total_offering, d.total_sold, d.total_remaining, d.minimum_investment, d.investors, d.first_sale, d.exemption, d.is_amendment) == (5e6, 3.5e6, None, 1000.0, 12, datetime.date(2021, 3, 15), "06b,3C.7", True)
    assert [(x.name, x.role, x.address) for x in d.related_persons] == [("Ann Poe", "Director, Promoter", "1 Main, Reno, NV")]
    h = parsed["form_d"]["form_d_html"]
    assert (h.issuer_name, h.jurisdiction, h.year_of_incorporation, h.industry_group, h.total_offering, h.total_sold, h.first_sale, h.is_amendment) == ("Gadget LLC", "NEVADA", 2001, "Other", 7e6, 500.0, datetime.date(2021, 3, 15), False)
    assert [(x.name, x.role, x.address) for x in h.related_persons] == [("Lee Moe", "Executive Officer", "2 Side St, Elko")]


def test_owners_and_insiders(parsed):
    s = parsed["schedule_13"]["schedule_13"]
    assert (s.owner_name, s.issuer_name, s.shares_owned, s.percent_of_class, s.event_date, s.purpose) == ("Big Holder LP", "Target Corp", 1.2e6, 8.4, datetime.date(2022, 5, 1), "Investment only")
    f = parsed["form_4"]["form_4"]
    assert (f.owner_name, f.owner_cik, f.issuer_cik, f.ticker, f.is_director, f.is_officer, f.is_ten_percent_owner, f.is_other, f.officer_title) == ("DOE JANE", "0000012345", "0000000777", "TGT", True, False, False, True, "Chair")
    assert (f.traded, f.code, f.shares, f.price, f.shares_after, f.held, len(f.trades)) == (datetime.date(2023, 2, 3), "P", 100.5, 12.25, None, "D", 2) and f.trades[1].traded == datetime.date(2023, 2, 4)


def test_holdings_and_reports(parsed):
    h = parsed["13f"]["13f"]
    assert h.total_value == 3e6 and [(x.cusip, x.issuer_name, x.value_usd, x.shares, x.share_type, x.put_call, x.discretion, x.voting_none) for x in h.holdings] == [("03783310A", "ALPHA CO", 1.5e6, 10000.0, "PRN", None, "SOLE", 5.0), ("123456789", "BETA & SONS", 1.5e6, None, "SH", "PUT", None, None)]
    r = parsed["s1"]["s1"]
    assert (r.issuer_name, r.proposed_offering, r.ticker, r.underwriters) == ("Newco Holdings", 1e8, "NEWC", ["First Securities Inc.", "Second & Co."])
    k8 = parsed["8k"]["8k"]
    assert k8.event_date == datetime.date(2024, 1, 5) and [tuple(i) for i in k8["items"]] == [("2.01", filings.ITEMS["2.01"], "We bought it. All of it."), ("9.99", "Something Quite Different", None)]
    k = parsed["10k"]["10k"]
    assert (k.fiscal_year_end, k.revenue, k.net_income, k.total_assets, [tuple(e) for e in k.executives]) == (datetime.date(2020, 12, 31), 9e5, -12e3, 3e6, [("Jane Doe", "Chief Executive Officer", 450e3)])


def test_headers(spark):
    html = "<pre><p>Accession Number: 0000012345-24-000001</p><p>Central Index Key: 12345</p><p>Filed as of date: 20240131</p><p>Conformed period of report: 20231231</p></pre>"
    (r,) = filings.headers(spark.createDataFrame([(1, html)], "id int, html string")).collect()
    assert tuple(r) == (1, "0000012345-24-000001", "0000012345", datetime.date(2024, 1, 31), datetime.date(2023, 12, 31))


def test_tables_in_plain_texts(spark):
    from ledgerline.sources import layouts

    text = """ANNUAL REPORT
As of June 30, 2024  ($ in millions)

Name                 Vintage      Value
Alpha  One LP           2001      1,200
Beta                              (30.5)
Gamma Fund of Funds     2010          7

just a line of prose
  and another   one

A1\t10   20
B2\t30   40
"""
    found = layouts.find_tables(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no  table")], "id int, text string"), "id", "text").orderBy("line").collect()
    assert [(r.as_of, r.unit, r.names, r.cells) for r in found[:3]] == [
        ("June 30, 2024", 1_000_000, ["name", "vintage", "value"], ["Alpha  One LP", "2001", "1,200"]), ("June 30, 2024", 1_000_000, ["name", "vintage", "value"], ["Beta", "", "(30.5)"]), ("June 30, 2024", 1_000_000, ["name", "vintage", "value"], ["Gamma Fund of Funds", "2010", "7"]),
    ]
    assert [(r.names, r.cells) for r in found[3:]] == [(["col_1", "col_2", "col_3"], ["A1", "10", "20"]), (["col_1", "col_2", "col_3"], ["B2", "30", "40"])]
    values = layouts.find_tables(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").select(layouts.amount("value").alias("v"), layouts.cell("nothing").alias("n")).collect()
    assert sorted(r.v for r in values if r.v is not None) == [-30.5e6, 7e6, 1.2e9] and all(r.n is None for r in values)


@pytest.mark.parametrize("name", ["filing_funds", "filing_offerings", "filing_holdings", "filing_trades"])
def test_no_filter_parses_documents_again(spark, name):
    from ledgerline.plans.catalog import QUERIES

    from .conftest import FOLDER

    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not [x for x in plan.splitlines() if "filter" in x.split("[")[0].split("(")[0] and ("xml" in x or "regexp" in x or "lambda" in x)]


def test_text_tables_are_cut_without_a_shuffle(spark):
    from ledgerline.sources import layouts

    texts = ["Name   Value\nA  b     1,000\r\nB      (2)\n\n \nx1  y2\nz3  w4\nno gap", "\tq   r\n\tés  t", "a  b", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = layouts.find_tables(frame, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert sorted((r.id, r.block, r.line, tuple(r.cells)) for r in found.collect()) == [(0, 0, 1, ("A  b", "1,000")), (0, 0, 2, ("B", "(2)")), (0, 2, 6, ("z3", "w4")), (1, 0, 1, ("és", "t"))]
