"""Fields of regulatory filings, as columns of tables of documents.

A document is read by its structure, once, in a function of Arrow arrays: `rows_of` gives the cells of its table rows and paragraphs,
`pairs_of` the labels and values among them. A record is an array of such pairs: the document itself, a row of a schedule under its
headings (`records`), or what follows a label until it comes again (`sections`). Forms are then maps from a field to its
labels and type. Forms that are filed as XML are read by their schema.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ENTITIES

# Titles of the items of a current report.
ITEMS = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Material Direct Financial Obligation",
    "3.02": "Unregistered Sales of Equity Securities",
    "5.02": "Departure/Election of Directors or Officers",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
}
BREAK = "\x01"
# Spaces, word ends and letters' case are those of ASCII, as in Spark's own expressions.
_HIDDEN = re.compile(r"(?ais)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_OPENED, _CLOSED = re.compile(r"(?ai)(<t[dh]\b[^>]*>)\s*<(?:p|div)\b[^>]*>"), re.compile(r"(?ai)</(?:p|div)>\s*(</t[dh]>)")
_LINE, _CELL = re.compile(r"(?ai)</?(?:tr|p|div|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|br)\b[^>]*>"), re.compile(r"(?ai)<t[dh]\b[^>]*>")
_TAG, _SPACE, _OTHER = re.compile(r"<[^>]*>"), re.compile(r"(?a)[\s\xa0]+"), re.compile(r"[^a-z0-9]+")
_WITHIN = re.compile(r"(?a)^([^:$]{2,80}?)\s*(?::\s*|(?=\$))(\S[^\x85\u2028\u2029]*)[\x85\u2028\u2029]?\Z")
PAIR = "array<struct<label:string,value:string>>"
STRUCTURE = f"struct<rows:array<array<string>>,keys:array<array<string>>,pairs:{PAIR}>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used, also inside functions of array elements."""
    return F.get(F.transform(F.array(value), use), 0)


# Structure ------------------------------------------------------------------------------------------------------------


def words(html: Column) -> Column:
    """Text without tags, entities resolved and spaces single."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[\s\x{A0}]+", " "))


def key(label: Column) -> Column:
    """A label as compared: lower case, letters and digits in single spaces."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def _plain(html: str) -> str:
    """As words()."""
    bare = _TAG.sub(" ", html)
    if "&" in bare:
        for entity, char in ENTITIES:
            bare = bare.replace(entity, char)
    return _SPACE.sub(" ", bare).strip(" ")


def rows_of(html: str) -> list[list[str]]:
    """The document's lines as lists of cells: those of a table row, empty ones included, or one for a paragraph."""
    inside = _CLOSED.sub(r"\1", _OPENED.sub(r"\1", _HIDDEN.sub(" ", html)))
    lines = ([_plain(c) for c in _CELL.split(x)] for x in _LINE.sub(BREAK, inside).split(BREAK))
    own = (c[1:] if len(c) > 1 else c for c in lines)
    return [c for c in own if any(c)]


def keys_of(rows: list[list[str]]) -> list[list[str]]:
    """rows with each cell as key() has it."""
    return [[_OTHER.sub(" ", c.lower()).strip(" ") for c in row] for row in rows]


def pairs_of(rows: list[list[str]], keys: list[list[str]]) -> tuple[list[str], list[str]]:
    """Labels and values: the first two cells of a row, the sides of a colon or before a dollar sign, and a line that ends in a colon with the next one."""
    labels, values = [], []
    for i, (row, own) in enumerate(zip(rows, keys, strict=True)):
        found = []
        if len(row) > 1:
            found.append((own[0], row[1]))
        elif row[0].endswith(":") and i + 1 < len(rows):
            found.append((own[0], rows[i + 1][0]))
        for cell in row:
            split = _WITHIN.search(cell) if ":" in cell or "$" in cell else None
            if split:
                found.append((keys_of([[split[1]]])[0][0], split[2].strip(" ")))
        for label, value in found:
            if label and value:
                labels.append(label)
                values.append(value)
    return labels, values


def structure(html: pa.Array) -> pa.Array:
    """A document's lines, their keys and its pairs. Null is an empty document."""
    rows = [rows_of(x or "") for x in html.to_pylist()]
    keys = [keys_of(x) for x in rows]
    pairs = [pairs_of(r, k) for r, k in zip(rows, keys, strict=True)]
    ends = pa.array(itertools.accumulate((len(labels) for labels, _ in pairs), initial=0), pa.int32())
    label, value = (pa.array(itertools.chain.from_iterable(p[i] for p in pairs), pa.string()) for i in (0, 1))
    cells = pa.list_(pa.list_(pa.string()))
    listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([label, value], ["label", "value"]))
    return pa.StructArray.from_arrays([pa.array(rows, cells), pa.array(keys, cells), listed], ["rows", "keys", "pairs"])


def field(record: Column, *labels: str) -> Column:
    """The first value under the first of the labels that the record has, alone or with more words behind."""
    under = lambda label: F.filter(record, lambda p: (p["label"] == label) | p["label"].startswith(label + " "))
    return F.coalesce(*(F.get(under(x), 0)["value"] for x in labels))


def records(rows: Column, keys: Column, *headings: str) -> Column:
    """The rows below the first table row that has one of the headings, as long as they have as many cells, as records.

    keys: rows with each cell as key() has it.
    """
    at = F.array_position(F.transform(keys, lambda k: (F.size(k) > 1) & F.arrays_overlap(k, F.array(*map(F.lit, headings)))), True).cast("int")

    def below(at: Column) -> Column:
        head = F.get(keys, at - 1)
        rest = F.slice(rows, at + 1, F.greatest(F.size(rows) - at, F.lit(0)))
        as_long = let(F.size(head), lambda n: F.transform(rest, lambda r: F.size(r) == n))
        ends = F.coalesce(F.nullif(F.array_position(as_long, False).cast("int"), F.lit(0)), F.size(rows) + 1)
        record = lambda r: F.zip_with(head, r, lambda h, v: F.struct(h.alias("label"), v.alias("value")))
        return let(ends, lambda e: F.transform(F.slice(rest, F.lit(1), e - 1), record))

    found = let(at, lambda at: F.when(at > 0, below(at)).otherwise(F.array().cast(f"array<{PAIR}>")))
    return F.transform(found, lambda r: F.filter(r, lambda p: p["value"] != ""))


def sections(pairs: Column, *starts: str) -> Column:
    """The pairs from each one with a starting label up to the next such, as records."""
    begins = F.filter(F.sequence(F.lit(0), F.size(pairs)), lambda i: F.coalesce(F.get(pairs, i)["label"].isin(*starts), F.lit(False)))
    until = lambda all, k: F.coalesce(F.get(all, k + 1), F.size(pairs))
    return let(begins, lambda all: F.transform(all, lambda b, k: F.slice(pairs, b + 1, until(all, k) - b)))


def heading(html: Column) -> Column:
    """The first heading of the document."""
    return F.nullif(words(F.regexp_extract(html, r"(?is)<h([1-3])\b[^>]*>(.*?)</h\1>", 2)), F.lit(""))


# Types ----------------------------------------------------------------------------------------------------------------


def number(c: Column) -> Column:
    """A number with signs of money, shares and thousands left out; in brackets it is negative."""
    bare = F.regexp_replace(c, r"[$,%\s]|(?i)\b(?:usd|shares)\b", "")
    return F.coalesce(bare.try_cast("double"), -F.regexp_extract(bare, r"^\((.*)\)$", 1).try_cast("double"))


def whole(c: Column) -> Column:
    return number(c).try_cast("long")


def day(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "MMMM d, yyyy")))


def yes(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "x")


def cik(c: Column) -> Column:
    """Ten digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


#: A field: its labels, and what its text becomes.
Fields = dict[str, tuple[tuple[str, ...], Callable[[Column], Column] | None]]


def typed(record: Column, fields: Fields) -> dict[str, Column]:
    return {n: let(field(record, *labels), kind) if kind else field(record, *labels) for n, (labels, kind) in fields.items()}


def struct_of(record: Column, fields: Fields) -> Column:
    return F.struct(*(c.alias(n) for n, c in typed(record, fields).items()))


def xml(html: Column, root: str, schema: str) -> Column:
    """The first element of that name, read by a schema; null without one. Prefixes of names are left out."""
    element = F.regexp_extract(html, rf"(?s)(<(?:\w+:)?{root}\b.*?</(?:\w+:)?{root}\s*>)", 1)
    return F.from_xml(F.nullif(element, F.lit("")), schema, {"ignoreNamespace": "true", "rowTag": root, "mode": "PERMISSIVE"})


# Forms ----------------------------------------------------------------------------------------------------------------

FUND: Fields = {
    "fund_name": (("name of private fund", "name of the private fund", "private fund name", "fund name", "reporting fund name"), None),
    "fund_id": (("private fund identification number", "identification number", "fund id", "807 number"), None),
    "fund_type": (("type of private fund", "type of fund", "fund type"), lower),
    "gross_asset_value": (("gross asset value", "current gross asset value"), number),
    "net_asset_value": (("net asset value",), number),
    "beneficial_owners": (("beneficial owners", "number of beneficial owners"), whole),
    "minimum_investment": (("minimum investment",), number),
    "master_feeder": (("master feeder", "master fund", "feeder fund"), None),
    "custodian": (("custodian", "name of custodian"), None),
    "auditor": (("auditor", "auditing firm"), None),
    "prime_broker": (("prime broker", "name of prime broker"), None),
    "state_country": (("state country", "country", "jurisdiction"), None),
}
PERSON: Fields = {"name": (("full legal name", "name"), None), "role": (("title or status", "title", "relationship", "position"), None), "share": (("ownership", "percent owned"), number), "address": (("address",), None)}
EXECUTIVE: Fields = {"name": (("name and principal position", "name"), None), "title": (("title", "principal position", "position"), None), "paid": (("total", "total compensation"), number)}


def _funds(d: Doc) -> Column:
    listed = records(d.rows, d.keys, *FUND["fund_id"][0])
    named = let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(sections(d.pairs, *FUND["fund_name"][0])))
    return F.filter(F.transform(named, lambda r: struct_of(r, FUND)), lambda f: f["fund_name"].isNotNull() | f["fund_id"].isNotNull())


def _people(d: Doc, fields: Fields = PERSON, *headings: str) -> Column:
    listed = records(d.rows, d.keys, *(headings or fields["name"][0]))
    return F.filter(F.transform(listed, lambda r: struct_of(r, fields)), lambda p: p["name"].isNotNull())


class Doc:
    """A document's columns: its markup, its lines, their keys and pairs, what was filed as XML, and who filed it."""

    def __init__(self, html: str, filer: str):
        self.html, self.rows, self.keys, self.pairs, self.xml, self.filer = map(F.col, (html, "_rows", "_keys", "_pairs", "_xml", filer))

    def named(self, *labels: str) -> Column:
        return F.coalesce(field(self.pairs, *labels), heading(self.html), self.filer)


HEADER: Fields = {
    "accession_no": (("accession number", "accession no"), None), "cik": (("central index key", "cik"), cik), "filed_at": (("filed as of date", "filing date", "filed"), day),
    "period_of_report": (("conformed period of report", "period of report"), day),
}


def adviser(d: Doc) -> dict[str, Column]:
    place = field(d.pairs, "principal office", "principal office and place of business", "main office")
    plain = typed(d.pairs, {
        "adviser_crd": (("crd number", "crd", "organization crd number"), lambda c: F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))), "adviser_sec_no": (("sec file number", "sec number", "sec no"), None),
        "total_aum": (("regulatory assets under management", "total regulatory assets under management", "total assets under management"), number), "employees": (("total number of employees", "number of employees", "employees"), whole),
    })
    link = F.nullif(F.regexp_extract(d.html, r"""(?is)web\s?site[^<]{0,20}(?:<(?!a\b)[^>]*>\s*)*<a\b[^>]*\bhref\s*=\s*["'](https?:[^"']+)""", 1), F.lit(""))
    site = field(d.pairs, "website", "web site", "website address")
    return plain | {
        "adviser_name": d.named("legal name", "adviser name", "primary business name"), "city": F.nullif(F.trim(F.split(place, ",")[0]), F.lit("")), "country": F.nullif(F.trim(F.element_at(F.split(place, ","), -1)), F.trim(F.split(place, ",")[0])),
        "website": F.coalesce(link, F.when(site.rlike(r"(?i)^(https?://|www\.)\S+$"), site)), "control_persons": _people(d, PERSON, "full legal name"), "funds": _funds(d),
    }


OFFERING = (
    "primaryIssuer struct<cik:string,entityName:string,jurisdictionOfInc:string,entityType:string,yearOfInc:struct<value:string>>,"
    "relatedPersonsList struct<relatedPersonInfo:array<struct<relatedPersonName:struct<firstName:string,lastName:string>,relatedPersonAddress:struct<street1:string,city:string,stateOrCountry:string>,relatedPersonRelationshipList:struct<relationship:array<string>>>>>,"
    "offeringData struct<industryGroup:struct<industryGroupType:string>,typeOfFiling:struct<newOrAmendment:struct<isAmendment:string>,dateOfFirstSale:struct<value:string>>,federalExemptionsExclusions:struct<item:array<string>>,minimumInvestmentAccepted:string,"
    "offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string,totalRemaining:string>,investors:struct<totalNumberAlreadyInvested:string>>"
)


def offering(d: Doc) -> dict[str, Column]:
    x = d.xml
    issuer, data, f = x["primaryIssuer"], x["offeringData"], lambda *labels: field(d.pairs, *labels)
    sums = data["offeringSalesAmounts"]
    place = lambda a: F.concat_ws(", ", a["street1"], a["city"], a["stateOrCountry"])
    person = lambda p: F.struct(
        F.concat_ws(" ", p["relatedPersonName"]["firstName"], p["relatedPersonName"]["lastName"]).alias("name"), F.array_join(p["relatedPersonRelationshipList"]["relationship"], ", ").alias("role"),
        F.lit(None).cast("double").alias("share"), F.nullif(place(p["relatedPersonAddress"]), F.lit("")).alias("address"),
    )
    return {
        "issuer_cik": cik(F.coalesce(issuer["cik"], f("issuer cik", "cik"))), "issuer_name": F.coalesce(issuer["entityName"], d.named("entity name of issuer", "name of issuer")), "jurisdiction": F.coalesce(issuer["jurisdictionOfInc"], f("jurisdiction of incorporation")),
        "year_of_incorporation": F.coalesce(issuer["yearOfInc"]["value"], f("year of incorporation")).try_cast("int"), "industry_group": F.coalesce(data["industryGroup"]["industryGroupType"], f("industry group")), "entity_type": F.coalesce(issuer["entityType"], f("entity type", "type of entity")),
        "total_offering": number(F.coalesce(sums["totalOfferingAmount"], f("total offering amount"))), "total_sold": number(F.coalesce(sums["totalAmountSold"], f("total amount sold"))), "total_remaining": number(F.coalesce(sums["totalRemaining"], f("total remaining"))),
        "minimum_investment": number(F.coalesce(data["minimumInvestmentAccepted"], f("minimum investment"))), "investors": whole(F.coalesce(data["investors"]["totalNumberAlreadyInvested"], f("total number of already investors", "total number of investors"))),
        "first_sale": day(F.coalesce(data["typeOfFiling"]["dateOfFirstSale"]["value"], f("date of first sale"))), "exemption": F.coalesce(F.array_join(data["federalExemptionsExclusions"]["item"], ","), f("exemption claimed", "exemption", "rule")),
        "is_amendment": F.coalesce(yes(F.coalesce(data["typeOfFiling"]["newOrAmendment"]["isAmendment"], f("is this offering an amendment", "amendment"))), F.lit(False)),
        "related_persons": F.coalesce(F.transform(x["relatedPersonsList"]["relatedPersonInfo"], person), _people(d)),
    }


HOLDING = (
    "infoTable array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string,investmentDiscretion:string,votingAuthority:struct<Sole:string,Shared:string,None:string>>>"
)


def holdings(d: Doc) -> dict[str, Column]:
    """Values are filed in thousands."""
    row = lambda h: F.struct(
        F.upper(h["cusip"]).alias("cusip"), h["nameOfIssuer"].alias("issuer_name"), h["titleOfClass"].alias("title_of_class"), (number(h["value"]) * 1000).alias("value_usd"), number(h["shrsOrPrnAmt"]["sshPrnamt"]).alias("shares"),
        F.coalesce(h["shrsOrPrnAmt"]["sshPrnamtType"], F.lit("SH")).alias("share_type"), F.upper(h["putCall"]).alias("put_call"), h["investmentDiscretion"].alias("discretion"),
        *(number(h["votingAuthority"][n]).alias(f"voting_{n.lower()}") for n in ("Sole", "Shared", "None")),
    )
    found = F.coalesce(F.filter(d.xml["infoTable"], lambda h: h["cusip"].isNotNull()), F.array())
    listed = F.transform(found, row)
    return {"filer_name": d.filer, "holdings": listed, "total_value": F.aggregate(listed, F.lit(0.0), lambda a, h: a + F.coalesce(h["value_usd"], F.lit(0.0)))}


def ownership(d: Doc) -> dict[str, Column]:
    return {"owner_name": F.coalesce(field(d.pairs, "name of reporting person", "names of reporting persons"), d.filer)} | typed(d.pairs, {
        "owner_cik": (("reporting person cik", "filer cik"), cik), "issuer_name": (("name of issuer",), None), "issuer_cik": (("issuer cik",), cik), "shares_owned": (("aggregate amount beneficially owned",), number),
        "percent_of_class": (("percent of class",), number), "event_date": (("date of event",), day), "purpose": (("purpose of transaction",), None),
    })


TRADE = "transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>,ownershipNature:struct<directOrIndirectOwnership:struct<value:string>>"
INSIDER = (
    "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>,"
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,isOther:string,officerTitle:string>>>,"
    f"nonDerivativeTable struct<nonDerivativeTransaction:array<struct<{TRADE}>>>"
)


def insider(d: Doc) -> dict[str, Column]:
    """The first owner, every trade, and the first trade's fields beside."""
    x = d.xml
    owner = F.get(x["reportingOwner"], 0)
    is_ = lambda n: F.coalesce(yes(owner["reportingOwnerRelationship"][n]), F.lit(False))
    trade = lambda t: F.struct(
        day(t["transactionDate"]["value"]).alias("traded"), t["transactionCoding"]["transactionCode"].alias("code"), number(t["transactionAmounts"]["transactionShares"]["value"]).alias("shares"), number(t["transactionAmounts"]["transactionPricePerShare"]["value"]).alias("price"),
        number(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]).alias("shares_after"), t["ownershipNature"]["directOrIndirectOwnership"]["value"].alias("held"),
    )
    trades = F.coalesce(F.transform(x["nonDerivativeTable"]["nonDerivativeTransaction"], trade), F.array())
    return {
        "owner_name": F.coalesce(owner["reportingOwnerId"]["rptOwnerName"], d.filer), "owner_cik": cik(owner["reportingOwnerId"]["rptOwnerCik"]), "issuer_name": x["issuer"]["issuerName"], "issuer_cik": cik(x["issuer"]["issuerCik"]), "ticker": x["issuer"]["issuerTradingSymbol"],
        "is_director": is_("isDirector"), "is_officer": is_("isOfficer"), "is_ten_percent_owner": is_("isTenPercentOwner"), "is_other": is_("isOther"), "officer_title": owner["reportingOwnerRelationship"]["officerTitle"], "trades": trades,
        **{n: F.get(trades, 0)[n] for n in ("traded", "code", "shares", "price", "shares_after", "held")},
    }


def registration(d: Doc) -> dict[str, Column]:
    listed = F.transform(records(d.rows, d.keys, "underwriter", "underwriters", "name of underwriter"), lambda r: field(r, "underwriter", "underwriters", "name of underwriter"))
    told = F.split(field(d.pairs, "underwriters", "underwriter", "joint book running managers"), r"\s*;\s*")
    return {
        "issuer_name": d.named("name of registrant", "exact name of registrant"), "issuer_cik": cik(field(d.pairs, "cik", "central index key")),
        "underwriters": F.array_distinct(F.filter(F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(told, F.array())), lambda u: u.isNotNull() & ~key(u).isin("total", ""))),
        "proposed_offering": number(field(d.pairs, "proposed maximum aggregate offering price")), "ticker": field(d.pairs, "trading symbol", "ticker symbol", "ticker"),
    }


def current_report(d: Doc) -> dict[str, Column]:
    """Items by their number: the fixed title, or the line's own, and the lines below it up to the next item."""
    lines = F.transform(d.rows, lambda r: F.array_join(r, " "))
    item = r"(?i)^item\s+(\d{1,2}\.\d{2})\s*[.:–—-]*\s*(.*)$"
    titles = F.create_map(*(F.lit(x) for kv in ITEMS.items() for x in kv))

    def told(lines: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: F.coalesce(F.get(lines, i).rlike(item), F.lit(False)))
        until = lambda all, k: F.coalesce(F.get(all, k + 1), F.size(lines))
        of = lambda b, group: F.regexp_extract(F.get(lines, b), item, group)
        title = lambda b: F.coalesce(F.try_element_at(titles, of(b, 1)), F.nullif(F.trim(of(b, 2)), F.lit("")))
        below = lambda b, end: F.nullif(F.array_join(F.slice(lines, b + 2, end - b - 1), " "), F.lit(""))
        return let(begins, lambda all: F.transform(all, lambda b, k: F.struct(of(b, 1).alias("item"), title(b).alias("title"), below(b, until(all, k)).alias("summary"))))

    again = lambda all, x, i: F.exists(F.slice(all, 1, i), lambda y: y["item"] == x["item"])
    items = let(let(lines, told), lambda all: F.filter(all, lambda x, i: ~again(all, x, i)))
    return {"issuer_name": d.named("exact name of registrant", "name of registrant"), "issuer_cik": cik(field(d.pairs, "cik", "central index key")), "event_date": day(field(d.pairs, "date of report", "date of earliest event reported")), "items": items}


def annual_report(d: Doc) -> dict[str, Column]:
    return {"issuer_name": d.named("exact name of registrant", "name of registrant"), "executives": _people(d, EXECUTIVE, "name and principal position")} | typed(d.pairs, {
        "issuer_cik": (("cik", "central index key"), cik), "fiscal_year_end": (("for the fiscal year ended", "fiscal year ended", "fiscal year end"), day), "revenue": (("total net revenues", "total net revenue", "total revenues", "total revenue"), number),
        "net_income": (("net income",), number), "total_assets": (("total assets",), number),
    })


def private_fund(d: Doc) -> dict[str, Column]:
    return {"adviser_name": d.named("adviser name", "legal name"), "funds": _funds(d)} | typed(d.pairs, {
        "adviser_crd": (("crd number", "crd"), lambda c: F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))), "total_aum": (("total regulatory assets under management", "regulatory assets under management"), number),
    })


#: Kind of form: what its type begins with (after FORM, SCHEDULE or SC, which count for nothing), parser.
FORMS: dict[str, tuple[tuple[str, ...], Callable[[Doc], dict[str, Column]]]] = {
    "adv": (("ADV",), adviser), "form_d": (("D",), offering), "13f": (("13F",), holdings), "schedule_13": (("13D", "13G"), ownership), "form_4": (("4",), insider),
    "s1": (("S-1",), registration), "8k": (("8-K",), current_report), "10k": (("10-K",), annual_report), "10q": (("10-Q",), annual_report), "pf": (("PF",), private_fund),
}
#: Forms that are filed as XML: the element, and its schema.
SCHEMAS = {"form_d": ("edgarSubmission", OFFERING), "13f": ("informationTable", HOLDING), "form_4": ("ownershipDocument", INSIDER)}


def classify(form_type: Column) -> Column:
    """A form's kind by its type: the name before a slash, hyphenated suffix or other sign; 'index' for others."""
    name = F.regexp_replace(F.upper(F.trim(form_type)), r"^(?:FORM|SCHEDULE|SC)\s*", "")
    starts = lambda s: (name == s) | (name.startswith(s) & ~F.substring(name, len(s) + 1, 1).rlike("[A-Z0-9]"))
    longer = lambda s: name.startswith(s) if "-" in s or s[:2] == "13" else starts(s)
    kinds = [F.when(longer(s), kind) for kind, (names, _) in FORMS.items() for s in names]
    return F.coalesce(*kinds, F.lit("index"))


def _read(filings: DataFrame, html: str) -> DataFrame:
    """filings with _rows, _keys and _pairs, each computed once."""
    return filings.withColumn("_s", F.arrow_udf(structure, STRUCTURE)(F.col(html))).select("*", *(F.col(f"_s.{c}").alias(f"_{c}") for c in ("rows", "keys", "pairs"))).drop("_s")


def parse(filings: DataFrame, kind: str, html: str = "html", filer: str = "filer_name") -> DataFrame:
    """The other columns of filings with the fields of one kind of form; what a document does not say is null, an empty list or false."""
    rows = _read(filings, html).withColumn("_xml", xml(F.col(html), *SCHEMAS[kind]) if kind in SCHEMAS else F.lit(None))
    fields = FORMS[kind][1](Doc(html, filer))
    return rows.select(*(c for c in filings.columns if c not in (html, filer)), *(c.alias(n) for n, c in fields.items()))


def headers(filings: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of filings with what the head of any form says."""
    return _read(filings, html).select(*(c for c in filings.columns if c != html), *(c.alias(n) for n, c in typed(F.col("_pairs"), HEADER).items()))


def parse_all(filings: DataFrame, form: str = "form_type", **columns) -> dict[str, DataFrame]:
    """A table for each kind of form, of the filings of that kind."""
    return {kind: parse(filings.filter(classify(F.col(form)) == kind), kind, **columns) for kind in FORMS}


def listed(parsed: DataFrame, keep: list[str], column: str) -> DataFrame:
    """One row for each entry of a list of parsed forms: funds, persons, holdings, trades, items.

    An inner explode would have Spark ask first whether the list is empty, below the parsing, and so parse each document again for that.
    """
    return parsed.select(*keep, F.explode_outer(column).alias("f")).filter("f is not null").select(*keep, "f.*")
