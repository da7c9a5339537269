"""String column helpers: keys, canonical forms, parsing, redaction and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with marks and their plain forms, position by position.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

# Legal forms that a company's key leaves out.
LEGAL_FORMS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa", "ag", "lp", "llp")

# Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "fbclid", "gclid", "dclid", "msclkid", "yclid",
    "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "_hsenc", "_hsmi", "hsctatracking", "vero_conv", "vero_id", "wickedid", "igshid",
)

#: (kind, pattern) in the order of replacement; none looks around itself.
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("phone", r"\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?[0-9]{3}-[0-9]{4}"),
    ("card", r"\b[0-9]{16}\b"),
)


def plain_letters(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def slug(c: Column) -> Column:
    """Lower case without marks; other characters become single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(plain_letters(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def company_key(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(plain_letters(c)), r"\b(" + "|".join(LEGAL_FORMS) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


# Words that a fund's key leaves out.
FUND_WORDS = r"\b(l\.?p\.?|llc|l\.?l\.?c\.?|ltd\.?|limited|inc\.?|incorporated|corp\.?|corporation|gmbh|s\.?a\.?|n\.?v\.?|plc|fund|funds|partners|partnership)\b"


# Roman numbers of funds, longer ones first.
ROMAN = {"xiii": 13, "xii": 12, "xi": 11, "viii": 8, "vii": 7, "vi": 6, "iv": 4, "iii": 3, "ii": 2, "ix": 9, "x": 10, "v": 5, "i": 1}


def fund_key(c: Column) -> Column:
    """Lower case with Arabic numbers and without legal forms; other characters become single spaces."""
    c = F.lower(F.trim(c))
    for roman, n in ROMAN.items():
        c = F.regexp_replace(c, rf"\b{roman}\b", str(n))
    return F.trim(F.regexp_replace(F.regexp_replace(c, FUND_WORDS, ""), "[^a-z0-9]+", " "))


def email_key(c: Column) -> Column:
    """Lower case without a +tag."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\+[^@]*@", "@")


#: Scheme, user, host and port of a URL.
AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?"


def host(url: Column) -> Column:
    """Lower case, without www, user or port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 2)), r"^www\.", "")


def phone_key(c: Column) -> Column:
    """E.164: +digits of 7 to 15, or of a number of 10 or 11 digits as in North America; null for others, as no country is guessed."""
    digits = F.regexp_replace(c, "[^0-9+]", "")
    return F.when(digits.startswith("+"), F.when(F.length(digits).between(8, 16), digits)).when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when(F.length(digits) == 11, F.concat(F.lit("+"), digits))


def linkedin_key(url: Column) -> Column:
    """The address of a person, company or school; null for others."""
    path = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/+$", ""))
    return F.when(host(url).endswith("linkedin.com") & path.rlike("^/(in|company|school)/[^/]+"), F.concat(F.lit("https://www.linkedin.com"), path))


def handle_key(url: Column, *hosts: str) -> Column:
    """The first step of the path of a page of one of these hosts, lower-case and without @, as of x.com or github.com; null for others."""
    name = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]+/@?([A-Za-z0-9_.-]+)", 1))
    return F.when(host(url).isin(*hosts) & (name != ""), name)


def clamp_words(c: Column, most: int) -> Column:
    """The first words, with single spaces, and an ellipsis if there were more."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, "…").otherwise(""))


def sorted_json(c: Column) -> Column:
    """A JSON object of plain values with its keys in order, for fingerprints; null if it is none."""
    entries = F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


# Words that are no part of a person's name.
TITLES = ("mr", "mrs", "ms", "mx", "dr", "prof", "sir", "dame", "lord", "lady", "hon", "hh", "mme", "mlle", "srta", "sra", "sr", "jr", "ii", "iii", "iv", "phd", "md", "esq")
# What sounds alike, in the order of replacement.
SOUNDS = (
    ("^(?:K(?=N)|G(?=N)|P(?=N)|A(?=E)|W(?=R))", ""), ("^X", "S"), ("^WH", "W"), ("MB$", "M"), ("SCH", "SK"), ("TH", "0"), ("CH", "X"), ("SH", "X"), ("PH", "F"), ("CK", "K"), ("Q", "K"), ("X", "KS"),
    ("[WY](?![AEIOU])", ""), ("Z", "S"), ("V", "F"), (r"(.)\1+", "$1"),
)


def person_name(c: Column) -> Column:
    """Lower case without marks; apostrophes and hyphens stay, other characters become single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain_letters(c)), r"[^a-z0-9\s'-]", " "), r"\s+", " "))


def name_words(c: Column) -> Column:
    """The words of person_name without titles and suffixes."""
    return F.filter(F.split(c, r"[\s'-]+"), lambda w: (w != "") & ~w.isin(*TITLES))


def metaphone(c: Column) -> Column:
    """Six letters at most for how a word sounds: SOUNDS, then no vowel but the first letter."""
    text = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    for pattern, to in SOUNDS:
        text = F.regexp_replace(text, pattern, to)
    return F.substring(F.concat(F.substring(text, 1, 1), F.regexp_replace(F.substring(text, 2, 1 << 20), "[AEIOU]", "")), 1, 6)


def canonical_url(url: Column) -> Column:
    """https, bare host, a port only if it is not a default one, single slashes, no user, fragment, tracking or trailing slash; parameters lower-case and sorted."""
    scheme, port = F.lower(F.regexp_extract(url, AUTHORITY, 1)), F.regexp_extract(url, AUTHORITY, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1), "/+", "/"), "/$", "")
    raw = F.split(F.lower(F.regexp_extract(url, r"\?([^#]*)", 1)), "&")
    kept = F.array_sort(F.filter(raw, lambda p: (p != "") & ~F.element_at(F.split(p, "="), 1).isin(*TRACKING)))
    return F.concat(F.lit("https://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def pii_counts(rows: DataFrame, text: str) -> DataFrame:
    """rows with a count per kind in place of the text; a kind sees the text after the kinds before it are replaced.

    A kind's marks are what its replacement leaves, so each text is rewritten once a kind and searched once at the end; marks that
    stand in the text beforehand are taken off.
    """
    known = rows
    for kind, pattern in PII:
        before = F.regexp_count(F.col("_t") if "_t" in known.columns else F.coalesce(text, F.lit("")), F.lit(rf"\[{kind}\]"))
        now = F.col("_t") if "_t" in known.columns else F.coalesce(text, F.lit(""))
        known = known.withColumn(f"_{kind}", before).withColumn("_t", F.regexp_replace(now, pattern, f"[{kind}]")).withColumn(kind, F.regexp_count("_t", F.lit(rf"\[{kind}\]")) - F.col(f"_{kind}"))
    return known.drop(text, "_t", *(f"_{kind}" for kind, _ in PII))


def redact_pii(c: Column) -> Column:
    for kind, pattern in PII:
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return c


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def money(c: Column) -> Column:
    """A number with an optional currency, thousands marks and k, m or bn; null if it is none."""
    text = F.lower(F.trim(c))
    number = F.regexp_extract(text, r"^[^0-9]{0,4}([0-9][0-9.,]*)\s*(k|m|bn|b)?(\s|$|usd|eur)", 1)
    scale = F.regexp_extract(text, r"^[^0-9]{0,4}[0-9][0-9.,]*\s*(bn|k|m|b)?", 1)
    # A comma before exactly two last digits is a decimal mark.
    decimal = F.when(number.rlike(r",[0-9]{1,2}$"), F.regexp_replace(F.replace(number, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(number, F.lit(","), F.lit("")))
    factor = F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale.isin("b", "bn"), 1e9).otherwise(1.0)
    return F.when(number != "", decimal.try_cast("double") * factor)


def money_range(c: Column) -> Column:
    """(low, high) of an amount or a range such as $5-10m or 1m to 2m; a bare first number takes the second's unit."""
    parts = F.split(F.lower(F.trim(c)), r"\s*(?:-|–|—|\bto\b)\s*")
    unit = F.regexp_extract(F.get(parts, F.lit(1)), r"(bn|k|m|b)\b", 1)
    first = F.when((F.size(parts) > 1) & ~F.get(parts, F.lit(0)).rlike(r"[0-9]\s*(bn|k|m|b)\b"), F.concat(F.get(parts, F.lit(0)), unit)).otherwise(F.get(parts, F.lit(0)))
    return F.struct(money(first).alias("low"), money(F.element_at(parts, -1)).alias("high"))


# Signs and codes of currencies.
CURRENCIES = {"€": "eur", "£": "gbp", "¥": "jpy", "$": "usd", "eur": "eur", "gbp": "gbp", "jpy": "jpy", "usd": "usd", "chf": "chf"}


def in_usd(c: Column, rates: dict[str, float]) -> Column:
    """money() in dollars, by the rate of the currency that the text names (dollars if none, null if it has no rate)."""
    text = F.lower(F.trim(c))
    code = F.coalesce(*(F.when(F.contains(text, F.lit(sign)), code) for sign, code in CURRENCIES.items()), F.lit("usd"))
    return money(c) * F.coalesce(*(F.when(code == k, v) for k, v in ({"usd": 1.0} | rates).items()))


def parse_bool(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin("yes", "y", "true", "1", "x"), True).when(text.isin("no", "n", "false", "0"), False)


def error_signature(c: Column) -> Column:
    """Quotes, ids, long hexadecimals and numbers of two digits and more as placeholders; 400 characters."""
    for pattern, mark in ((r"'[^']*'|\"[^\"]*\"", "<q>"), (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"), (r"\b[0-9a-f]{16,}\b", "<hex>"), (r"[0-9]{2,}", "<n>")):
        c = F.regexp_replace(c, pattern, mark)
    return F.substring(c, 1, 400)


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least so many letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


STOPWORDS = ("the a an of and or to in on for by with is was are were be been being at from as it its this that these those their").split()


def plain_words(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces between; the empty text of null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def key_words(c: Column) -> Column:
    """The words of plain_words that are longer than a character and no stopwords, repeated ones included."""
    return F.filter(F.split(c, " "), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters' code points, for bucketing of plain ids."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    # (h ^ byte) * 16777619 mod 2 ** 32 stays below 2 ** 57.
    step = lambda h, x: F.pmod(h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619).cast("long"), F.lit(1 << 32))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def name_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length, of plain lower-case names."""
    a, b = F.lower(plain_letters(a)), F.lower(plain_letters(b))
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
