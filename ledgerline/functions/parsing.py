"""Parsing of typed cells: numbers, years, dates, stages, countries and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of empty cells.
EMPTY = ("", "-", "--", "n/a", "na", "none", "null", "nil", "tbd", "unknown")
# Spellings of funding stages and the stage they stand for.
STAGES = {
    "pre-seed": "pre_seed", "preseed": "pre_seed", "pre seed": "pre_seed", "seed": "seed", "angel": "seed", "series a": "series_a", "a round": "series_a", "series b": "series_b",
    "b round": "series_b", "series c": "series_c", "growth": "growth", "late stage": "growth", "series d": "growth", "ipo": "public", "public": "public",
}


def is_empty(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*EMPTY)


def percent(c: Column) -> Column:
    """A share: '12.5%' and '12,5 %' are 0.125, a bare number above 1 counts as per cent."""
    text = F.replace(F.trim(c), F.lit(","), F.lit("."))
    number = F.regexp_extract(text, r"^([-+]?[0-9]*\.?[0-9]+)\s*%?$", 1).try_cast("double")
    return F.when(text.endswith("%") | (F.abs(number) > 1), number / 100).otherwise(number)


def year(c: Column, latest: int) -> Column:
    """A year of four digits, 'FY21' or "'21"; null outside 1900 to latest."""
    four = F.regexp_extract(c, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    two = F.regexp_extract(F.lower(c), r"(?:fy|')\s*([0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    found = F.coalesce(four, F.when(two <= latest % 100, 2000 + two).otherwise(1900 + two))
    return F.when(found.between(1900, latest), found)


def date(c: Column, day_first: bool = True) -> Column:
    """A date in ISO, numeric or written form; null if it is none."""
    numeric = ("d/M/y", "d.M.y") if day_first else ("M/d/y", "M.d.y")
    formats = ("y-M-d", *numeric, "d MMM y", "MMM d, y", "d MMMM y", "MMMM d, y")
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in formats))


def stages(c: Column) -> Column:
    """Distinct stages of a list split at commas, slashes, bars or semicolons, in order."""
    names = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    parts = F.transform(F.split(F.lower(c), r"[,/|;]"), lambda x: F.try_element_at(names, F.trim(x)))
    return F.array_distinct(F.array_compact(parts))


def months_between(a: Column, b: Column) -> Column:
    """Months of 30.44 days from a to b."""
    return F.datediff(b, a) / 30.44


def overlap_months(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    return F.greatest(F.lit(0.0), months_between(F.greatest(from_a, from_b), F.least(to_a, to_b)))


def next_digest(now: Column, zone: Column, hour: int, weekday: str | None = None) -> Column:
    """The next instant after now at that local hour, on that weekday if given: exact across clock changes."""
    local = F.from_utc_timestamp(now, zone)
    day = F.to_date(local)
    at = lambda d: F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(hour), d.cast("timestamp")), zone)
    first = day if weekday is None else F.next_day(F.date_sub(day, 1), weekday)
    later = F.date_add(first, 1 if weekday is None else 7)
    return F.when(at(first) > now, at(first)).otherwise(at(later))


def initial_key(c: Column, length: int = 6) -> Column:
    """A phonetic key of a plain name: like-sounding letters alike, vowels after the first dropped, no doubles."""
    text = F.regexp_replace(F.lower(c), "[^a-z]", "")
    for pattern, to in (("ph", "f"), ("gh|ck|q", "k"), ("[sc](?=[eiy])|z", "s"), ("c", "k"), ("[dt]h?", "t"), ("[vw]", "f"), ("x", "ks"), ("[gj]", "j"), ("b", "p"), ("m", "n")):
        text = F.regexp_replace(text, pattern, to)
    rest = F.regexp_replace(F.substring(text, 2, 100), "[aeiouyh]", "")
    return F.substring(F.regexp_replace(F.concat(F.substring(text, 1, 1), rest), r"(.)\1+", "$1"), 1, length)
