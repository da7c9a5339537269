"""Headers to fields, fixed-layout text tables, holdings documents and export dialects."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header spellings of each field.
ALIASES = {
    "name": ("name", "full name", "contact", "contact name"), "email": ("email", "e-mail", "mail", "email address"), "org": ("company", "firm", "organisation", "organization", "org"),
    "title": ("title", "role", "position", "job title"), "phone": ("phone", "telephone", "mobile"), "url": ("website", "url", "web", "domain"), "country": ("country", "nation"),
    "amount": ("amount", "amount usd", "check size", "raised"), "date": ("date", "announced", "closing date"), "stage": ("stage", "round", "series"),
}


def map_headers(headers: list[str], least: float = 0.8) -> dict[str, tuple[str, float]]:
    """field -> (header, confidence): exact aliases first, then the nearest spelling; each header and field once."""
    plain = {h: re.sub(r"[^a-z0-9]+", " ", h.lower()).strip() for h in headers}
    scored = []
    for field, names in ALIASES.items():
        for position, h in enumerate(headers):
            best = max(1.0 if plain[h] == re.sub(r"[^a-z0-9]+", " ", n).strip() else 0.95 * difflib.SequenceMatcher(None, plain[h], n).ratio() for n in names)
            if best >= least:
                scored.append((-best, position, field, h))
    found: dict[str, tuple[str, float]] = {}
    used: set[str] = set()
    for score, _, field, h in sorted(scored):
        if field not in found and h not in used:
            found[field] = (h, round(-score, 4))
            used.add(h)
    return found


def rename_fields(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """rows under the fields' names; columns that map to no field keep theirs."""
    return rows.withColumnsRenamed({h: f for f, (h, _) in map_headers(rows.columns, least).items()})


#: Blank positions between two columns at least, and columns of a table at least.
GAP, COLUMNS = 2, 2
NUMERIC = re.compile(r"[($-]*[0-9][0-9,.]*[)%]?")
_NEWLINE, _GAPPED = re.compile(r"\r?\n"), re.compile(rf"(?a)\S\s{{{GAP},}}\S")


def _document_terms(text: Column) -> tuple[Column, Column]:
    """The date as of which a document speaks, as written, and by what its numbers are multiplied."""
    as_of = F.regexp_extract(text, r"(?i)as of:?\s+([A-Za-z]+ \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})", 1)
    low = F.lower(text)
    unit = F.when(low.rlike(r"in billions"), 1_000_000_000).when(low.rlike(r"in millions|\(\$?mm\)"), 1_000_000).when(low.rlike(r"in thousands|\(\$?000'?s?\)"), 1_000).otherwise(1)
    return F.nullif(as_of, F.lit("")), unit.cast("long")


def find_tables(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, as_of, unit, block, line, names, cells of the tables in plain texts, whose columns are found from where their lines are blank.

    A block is a run of lines that aren't blank, and a column of it begins after GAP positions that are blank in all of its lines; a line without an
    inner gap, as a title, is left out of that. A block of two such lines and COLUMNS columns is a table. Its first line gives the names if no cell of it but the first
    is a number; else they are col_1 and so on. A document is cut where it is read, without a shuffle of its lines. Null texts have no tables.
    """
    as_of, unit = _document_terms(F.col(text))
    kind = dict(documents.dtypes)[doc_id]
    schema = f"`{doc_id}` {kind}, as_of string, unit long, block long, line int, names array<string>, cells array<string>"
    return documents.select(doc_id, as_of.alias("as_of"), unit.alias("unit"), F.col(text).alias("_text")).mapInArrow(_cut, schema)


def _blocks(text: str):
    """block, lines, texts: the runs of lines that aren't blank, without those that have no inner gap."""
    block, lines, texts = 0, [], []
    for line, x in enumerate([*_NEWLINE.split(text.replace("\t", "    ")), ""]):
        bare = x.strip(" ")
        if bare:
            if _GAPPED.search(bare):
                lines.append(line)
                texts.append(x.rstrip(" "))
            continue
        if len(lines) > 1:
            yield block, lines, texts
        block, lines, texts = block + 1, [], []


def _begins(lines: list[str]) -> list[int]:
    """Where the columns of a block begin: behind GAP positions that are blank in all lines, and at the first that isn't."""
    width = max(map(len, lines))
    letters = "".join(x.ljust(width) for x in lines).encode("utf-32-le", "surrogatepass")
    shown = (np.frombuffer(letters, np.uint32).reshape(len(lines), width) != ord(" ")).any(axis=0)
    before = np.concatenate([np.zeros(GAP, bool), shown])
    return np.flatnonzero(shown & ~np.logical_or.reduce([before[k : k + width] for k in range(GAP)])).tolist()


def _cut(batches):
    """Documents (id, as_of, unit, _text) -> rows of their blocks that are tables."""
    for batch in batches:
        at, found = [], []
        for i, text in enumerate(batch.column("_text").to_pylist()):
            for block, lines, texts in _blocks(text or ""):
                begins = _begins(texts)
                if len(begins) < COLUMNS:
                    continue
                cells = [[x[p:q].strip() for p, q in zip(begins, [*begins[1:], None], strict=True)] for x in texts]
                headed = not any(NUMERIC.fullmatch(c) for c in cells[0][1:])
                names = [(re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") if headed else "") or f"col_{k}" for k, c in enumerate(cells[0], 1)]
                for line, own in list(zip(lines, cells, strict=True))[headed:]:
                    at.append(i)
                    found.append((block, line, names, own))
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        texts = pa.list_(pa.string())
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), texts, texts), strict=True)]
        keys = batch.schema.names[:3]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *arrays], [*keys, "block", "line", "names", "cells"])


def cell(name: str) -> Column:
    """The text of a found table's column by its name; null where the table has none."""
    return F.get("cells", F.array_position("names", name).cast("int") - 1)


def amount(name: str) -> Column:
    """The number of a cell times the document's unit; negative in brackets."""
    bare = F.regexp_replace(cell(name), r"[$,\s]", "")
    value = F.coalesce(bare.try_cast("double"), -F.regexp_extract(bare, r"^\((.*)\)$", 1).try_cast("double"))
    return value * F.col("unit")


def text_table(documents: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of plain-text tables: the other columns, as_of, unit and the given columns as strings.

    Cells are apart by two spaces or more; a line counts if it has as many cells
    as columns and a digit in its last. A line "as of <date>" and one with
    "in thousands" or "in millions" hold for the whole document.
    """
    as_of = F.regexp_extract(text, r"(?i)as of\s+([A-Za-z]+ \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2})", 1)
    unit = F.when(F.lower(text).contains("in thousands"), 1_000).when(F.lower(text).contains("in millions"), 1_000_000).otherwise(1)
    lines = documents.select(*(c for c in documents.columns if c != text), F.nullif(as_of, F.lit("")).alias("as_of"), unit.alias("unit"), F.explode(F.split(text, r"\r?\n")).alias("_line"))
    cells = lines.withColumn("_cells", F.split(F.trim("_line"), r"\s{2,}"))
    kept = cells.filter((F.size("_cells") == len(columns)) & F.element_at("_cells", -1).rlike(r"\d"))
    return kept.select(*(c for c in kept.columns if c not in ("_line", "_cells")), *(F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def xml_records(documents: DataFrame, xml: str, record: str, fields: dict[str, str]) -> DataFrame:
    """The other columns of documents with one row for each <record>; fields: name -> tag, null where missing."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?is)<{record}\b[^>]*>(.*?)</{record}>"), F.lit(1))
    rows = documents.select(*(c for c in documents.columns if c != xml), F.explode(found).alias("_r"))
    inner = lambda tag: F.nullif(F.trim(F.regexp_extract("_r", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return rows.select("*", *(inner(tag).alias(name) for name, tag in fields.items())).drop("_r")


#: Column names and order that mailing tools expect: name -> (column of ours, or a literal).
DIALECTS: dict[str, dict[str, str]] = {
    "plain": {"email": "email", "name": "name", "company": "org", "title": "title"},
    "split_names": {"Email": "email", "First Name": "first_name", "Last Name": "last_name", "Company": "org"},
    "crm": {"Email Address": "email", "Full Name": "name", "Account Name": "org", "Lead Source": "=import"},
    "sequences": {"email": "email", "firstName": "first_name", "lastName": "last_name", "companyName": "org", "jobTitle": "title", "linkedinUrl": "linkedin_url", "phone": "phone"},
    "sales": {"First Name": "first_name", "Last Name": "last_name", "Title": "title", "Company": "org", "Email": "email", "Phone": "phone", "Person Linkedin Url": "linkedin_url", "Country": "country"},
}


def campaign(rows: DataFrame, dialect: str) -> DataFrame:
    """rows in a mailing tool's layout; first_name and last_name are split off name; missing columns are empty."""
    first, last = F.substring_index("name", " ", 1), F.when(F.col("name").contains(" "), F.regexp_extract("name", r"^\S+\s+(.*)$", 1)).otherwise("")
    extra = {"first_name": first, "last_name": last} if "name" in rows.columns else {}

    def column(source: str) -> Column:
        if source.startswith("="):
            return F.lit(source[1:])
        return extra.get(source, F.coalesce(F.col(source), F.lit("")) if source in rows.columns else F.lit(""))

    return rows.select(*(column(source).alias(name) for name, source in DIALECTS[dialect].items()))
