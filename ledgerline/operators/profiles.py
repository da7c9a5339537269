"""Scores of leads, accounts, ideal customers and personas, part by part."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_life, half_up
from .relations import haversine

# Weights and fields of a lead's quality.
LEAD_WEIGHTS = {"completeness": 0.30, "verification": 0.20, "corroboration": 0.15, "freshness": 0.15, "persona_match": 0.10, "track_record": 0.10}
LEAD_FIELDS = ("name", "email", "org", "title", "phone", "linkedin_url", "country_iso2", "city", "persona_role", "seniority", "bio")
TRACK_RECORD = ("companies_json", "board_seats_json", "awards_json", "exits_json")
# Weights of a persona's parts for accounts and for buyers.
ACCOUNT_WEIGHTS = {"size": 0.10, "geo": 0.10, "industry": 0.20, "tech": 0.10, "signal": 0.20, "buyer": 0.10, "semantic": 0.20}
BUYER_WEIGHTS = {"size": 0.05, "geo": 0.05, "industry": 0.15, "tech": 0.05, "signal": 0.10, "buyer": 0.45, "semantic": 0.15}
# Countries of the regions that a persona may name.
REGIONS = {
    "emea": ("gb", "ie", "fr", "de", "es", "it", "nl", "be", "se", "no", "fi", "dk", "pt", "pl", "ch", "at"),
    "apac": ("jp", "sg", "au", "nz", "kr", "in", "hk", "tw", "my", "id", "ph", "th", "vn"),
    "latam": ("br", "mx", "ar", "cl", "co", "pe", "uy"),
    "africa": ("za", "ng", "ke", "eg", "ma"),
}


def filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def lead_quality(leads: DataFrame, id_col: str, as_of: Column, half: float = 30) -> DataFrame:
    """id, score and its six parts, to three places.

    leads: LEAD_FIELDS, TRACK_RECORD (JSON arrays as text), verified, providers (an array), last_enriched_at. Blank counts as
    missing and malformed JSON as empty. Freshness halves every `half` days.
    """
    days = F.datediff(as_of, F.col("last_enriched_at").cast("date"))
    parts = {
        "completeness": total(filled(f).cast("double") for f in LEAD_FIELDS) / len(LEAD_FIELDS),
        "verification": 0.5 * flag(F.col("verified")) + 0.25 * filled("email").cast("double") + 0.25 * (filled("phone") | filled("linkedin_url")).cast("double"),
        "corroboration": F.least(F.lit(1.0), F.size(F.array_distinct(F.coalesce("providers", F.array().cast("array<string>")))) / 3),
        "freshness": F.when(days >= 0, half_life(days, half)).otherwise(0.0),
        "persona_match": F.when(filled("persona_role"), F.when(filled("seniority"), 1.0).otherwise(0.5)).otherwise(0.0),
        "track_record": total(flag(F.json_array_length(f) > 0) for f in TRACK_RECORD) / len(TRACK_RECORD),
    }
    score = total(c * LEAD_WEIGHTS[name] for name, c in parts.items())
    return leads.select(id_col, half_up(score, 3).alias("score"), *(half_up(c, 3).alias(name) for name, c in parts.items()))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s_/-]+"), lambda w: F.length(w) > 2)


def _among(c: Column, values) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin([v.lower() for v in values]), F.lit(False))


def account_fit(accounts: DataFrame, buyers: DataFrame, icp: dict, id_col: str = "account") -> DataFrame:
    """account, fit and its five parts (0 to 100): industry, size, geo, funding, buyer, by icp["weights"].

    accounts: account, industries (array), size_band, employees, country, stage; buyers: account, role, department, seniority, title.
    icp: industries, size_bands, size_min, size_max, geos, stages, roles (name -> department, seniority, aliases), weights.
    A part without a wish is a neutral 50. A wished role is covered by a buyer of that role, or for 0.6 by one of its
    department and seniority, or whose title holds an alias.
    """
    want = [x.lower() for x in icp["industries"]]
    have = F.array_distinct(F.filter(F.transform(F.coalesce("industries", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    matches = F.size(F.array_intersect(have, F.array(*map(F.lit, want)))) if want else F.lit(0)
    hints = sorted({w for x in want for w in x.replace("_", " ").replace("/", " ").replace("-", " ").split() if len(w) > 2})
    loose = F.arrays_overlap(F.flatten(F.transform(have, _words)), F.array(*map(F.lit, hints))) if hints else F.lit(False)
    industry = F.when(F.size(have) == 0, 0.0).when(matches > 0, F.least(F.lit(100.0), 70 + matches * 15.0)).when(loose, 25.0).otherwise(0.0) if want else F.lit(50.0)

    low, high, staff = icp.get("size_min"), icp.get("size_max"), F.when(F.col("employees") > 0, F.col("employees"))
    inside = (staff >= (low or 0)) & (staff <= (high if high is not None else math.inf))
    band = _among(F.col("size_band"), icp["size_bands"])
    off = F.when(staff < (low or 0), ((low or 0) - staff) / max(low or 0, 1)).otherwise((staff - (high or 0)) / max(high or 0, 1))
    size = F.when(band & (staff.isNull() | inside), 100.0).when(inside, 85.0).when(staff.isNotNull(), F.greatest(F.lit(0.0), half_up(60 - off * 60))).when(filled("size_band"), 30.0).otherwise(0.0)
    geo = F.when(_among(F.col("country"), icp["geos"]), 100.0).otherwise(0.0) if icp["geos"] else F.lit(50.0)
    stage = F.when(~filled("stage"), 30.0).when(_among(F.col("stage"), icp["stages"]), 100.0).otherwise(20.0) if icp["stages"] else F.lit(50.0)

    covered = []
    for role, (department, seniority, aliases) in icp["roles"].items():
        like = F.coalesce((F.lower("department") == department) & (F.lower("seniority") == seniority), F.lit(False))
        titled = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower("title"), F.lit(a)), F.lit(False)) for a in aliases), F.lit(False))
        covered.append(F.max(F.when(_among(F.col("role"), [role]), 1.0).when(like | titled, 0.6).otherwise(0.0)))
    coverage = buyers.groupBy(id_col).agg(total(covered).alias("_covered")) if covered else None
    joined = accounts.join(coverage, id_col, "left") if covered else accounts
    buyer = F.least(F.lit(100.0), half_up(F.coalesce("_covered", F.lit(0.0)) / len(covered) * 100)) if covered else F.lit(50.0)
    parts = {"industry": industry, "size": size, "geo": geo, "funding": stage, "buyer": buyer}
    weights = icp["weights"]
    fit = total(c * weights[n] for n, c in parts.items()) / sum(weights[n] for n in parts)
    return joined.select(id_col, half_up(clamp(fit, 0.0, 100.0), 2).alias("fit"), *(c.alias(n) for n, c in parts.items()))


def blend(intent: Column, fit: Column) -> Column:
    """0.6 of an intent score and 0.4 of a fit, both clamped to 0..100; missing ones are 0."""
    of = lambda c: clamp(F.coalesce(c, F.lit(0.0)), 0.0, 100.0)
    return half_up(0.6 * of(intent) + 0.4 * of(fit), 2)


def icp_match(leads: DataFrame, icp: dict, weights: dict[str, float], id_col: str = "id", min_score: float = 0.0) -> DataFrame:
    """id, score, reasons of the leads that pass an ideal customer profile's filters, by eight weights.

    icp: lists for sector, geography (also countries of two letters), persona, seniority, tags_any, tags_all; exclude_dnc, require_email,
    require_linkedin, min_aum, min_fund. A wish that is not made counts as met, without a reason; quality is a constant half.
    """
    countries = [g.upper() for g in icp["geography"] if len(g) == 2]
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    any_of = F.arrays_overlap(tags, F.array(*map(F.lit, icp["tags_any"]))) if icp["tags_any"] else None
    listed = {
        "sector": (icp["sector"], F.col("sector").isin(icp["sector"])),
        "geography": (icp["geography"], F.col("geo").isin(icp["geography"]) | F.coalesce(F.col("country").isin(countries), F.lit(False))),
        "persona": (icp["persona"], F.col("persona_role").isin(icp["persona"])),
        "seniority": (icp["seniority"], F.col("seniority").isin(icp["seniority"])),
    }
    keep = [F.coalesce(hit, F.lit(False)) for wish, hit in listed.values() if wish]
    keep += [~F.coalesce(F.col("do_not_contact"), F.lit(False))] if icp.get("exclude_dnc") else []
    keep += [filled("email")] if icp.get("require_email") else []
    keep += [filled("linkedin_url")] if icp.get("require_linkedin") else []
    keep += [F.coalesce(F.col(c) >= icp[k], F.lit(False)) for c, k in (("aum", "min_aum"), ("fund_size", "min_fund")) if icp.get(k) is not None]
    keep += [F.array_contains(tags, t) for t in icp["tags_all"]] + ([any_of] if any_of is not None else [])
    financial = flag((F.coalesce("aum", F.lit(0.0)) != 0) | (F.coalesce("fund_size", F.lit(0.0)) != 0))
    contact = flag(filled("email") | filled("linkedin_url"))
    scored = {name: (F.lit(1.0), bool(wish)) for name, (wish, _) in listed.items()}  # those that do not hold are filtered
    scored |= {"financial": (financial, True), "contact": (contact, True), "quality": (F.lit(0.5), False)}
    scored["tags"] = (F.lit(1.0 if icp["tags_any"] or not icp["tags_all"] else 0.0), bool(icp["tags_any"]))
    score = half_up(total(c * weights[n] for n, (c, _) in scored.items()), 4)
    reasons = F.array_compact(F.array(*(F.when(c > 0, F.lit(n)) for n, (c, said) in scored.items() if said)))
    passing = leads.filter(reduce(lambda a, b: a & b, keep, F.lit(True)))
    return passing.select(id_col, score.alias("score"), F.array_join(reasons, ",").alias("reasons")).filter(F.col("score") >= min_score)


def persona_fit(accounts: DataFrame, persona: dict, as_of: Column, weights: dict[str, float] = ACCOUNT_WEIGHTS, id_col: str = "account") -> DataFrame:
    """account, fit (0 to 100) and its parts: hard filters first, then size, geo, industry, tech, signal, buyer and semantic, with a boost for recency.

    accounts: status, country, stage, domain, employees, size_band, industry, industries, techs, signals (kind, weight, confidence, at), buyers
    (title, seniority, department, decides), cosine, modified. persona: as the parts ask. A failed hard filter or technology gives 0.
    """
    lower = lambda xs: [x.lower() for x in xs]
    array = lambda xs: F.array(*map(F.lit, lower(xs))) if xs else F.array().cast("array<string>")
    lowered = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x))
    hard, country = persona.get("hard", {}), F.lower("country")
    passes = [F.lit(True)]
    passes += [filled("domain")] if hard.get("require_domain") else []
    passes += [_among(F.col("status"), hard["statuses_in"])] if "statuses_in" in hard else []
    passes += [~_among(F.col("country"), hard["exclude_countries"])] if "exclude_countries" in hard else []
    passes += [_among(F.col("country"), hard["countries_in"])] if "countries_in" in hard else []
    passes += [_among(F.col("stage"), hard["stages_in"])] if "stages_in" in hard else []
    techs = lowered("techs")
    passes += [~F.arrays_overlap(techs, array(persona["techs_excluded"]))] if persona["techs_excluded"] else []
    passes += [F.array_contains(techs, t) for t in lower(persona["techs_required"])]

    low, high, staff = persona.get("size_min"), persona.get("size_max"), F.col("employees")
    top = high if high is not None else float(1 << 53)
    if low is None and high is None and not persona["size_bands"]:
        size = F.lit(50.0)
    else:
        ratio = F.when(staff < (low or 0), (low or 0) / F.greatest(F.lit(1.0), staff.cast("double"))).otherwise(staff / top)
        size = F.when(_among(F.col("size_band"), persona["size_bands"]), 100.0).when(staff.isNull(), 25.0).when(staff.between(low or 0, top), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - half_up(F.log10(ratio) * 60)))
    geo = F.lit(0.0)
    for slug in reversed(persona["geos"]):
        geo = F.when(country.isin(list(REGIONS[slug])), 80.0).otherwise(geo) if slug in REGIONS else F.when(country.isNotNull(), 60.0).otherwise(geo) if slug == "global" else geo
    geo = F.when(country.isNull(), 20.0).when(country.isin(lower(persona["geos"])), 100.0).otherwise(geo) if persona["geos"] else F.lit(50.0)
    want = lower(persona["industries"])
    industry = F.when(F.coalesce(F.lower("industry").isin(want), F.lit(False)), 100.0).when(F.arrays_overlap(lowered("industries"), array(want)), 80.0).otherwise(0.0) if want else F.lit(50.0)
    preferred = persona["techs_preferred"]
    tech = half_up(60 + 40 * (F.size(F.array_intersect(array(preferred), techs)) / len(preferred))) if preferred else F.lit(100.0 if persona["techs_required"] else 50.0)

    kinds = lower(persona["signal_kinds"])
    def credit(s: Column) -> Column:
        age = F.greatest(F.lit(0.0), F.coalesce(F.datediff(as_of, s["at"]).cast("double"), F.lit(365.0)))
        wished = F.when(F.lower(s["kind"]).isin(kinds), 1.0).otherwise(0.25) if kinds else F.lit(0.5)
        return F.coalesce(s["weight"], F.lit(0.0)) * F.coalesce(s["confidence"], F.lit(1.0)) * F.exp(-age / 30) * wished

    signals = F.aggregate(F.transform("signals", credit), F.lit(0.0), lambda a, x: a + x)
    signal = F.when(F.size("signals") > 0, half_up(100 * (1 - F.exp(-signals / 15)))).otherwise(0.0)

    titles, ranks, departments = (lower(persona[k]) for k in ("buyer_titles", "buyer_seniority", "buyer_departments"))
    most = 50 * bool(titles) + 30 * bool(ranks) + 20 * bool(departments)
    def of_buyer(b: Column) -> Column:
        title = reduce(lambda x, y: x | y, (F.contains(F.lower(b["title"]), F.lit(t)) for t in titles), F.lit(False))
        points = 50 * flag(title) + 30 * flag(F.lower(b["seniority"]).isin(ranks) if ranks else F.lit(False)) + 20 * flag(F.lower(b["department"]).isin(departments) if departments else F.lit(False))
        return half_up(F.when(F.coalesce(b["decides"], F.lit(False)), F.least(F.lit(float(most)), points + 5)).otherwise(points) / most * 100)

    none = 0.0 if titles or ranks else 50.0
    buyer = F.coalesce(F.array_max(F.transform("buyers", of_buyer)), F.lit(none)) if most else F.lit(50.0)
    cosine = F.col("cosine")
    semantic = F.when(cosine.isNull(), 50.0).when(cosine < persona.get("semantic_least", 0.55), 0.0).otherwise(half_up(clamp((cosine - 0.4) / 0.5) * 100))
    parts = {"size": size, "geo": geo, "industry": industry, "tech": tech, "signal": signal, "buyer": buyer, "semantic": semantic}
    blended = total(c * weights[n] for n, c in parts.items()) / sum(weights.values())
    days = F.datediff(as_of, F.col("modified").cast("date"))
    boost = F.lit(min(1.2, max(1.0, persona["boost"]))) if persona.get("boost") else F.when(days <= 7, 1.15).when(days <= 30, 1.05).otherwise(1.0)
    passed = reduce(lambda a, b: a & b, passes)
    named = {n: F.when(passed, c).otherwise(0.0) for n, c in parts.items()}
    return accounts.select(id_col, F.when(passed, half_up(clamp(blended * boost, 0.0, 100.0))).otherwise(0.0).alias("fit"), *(c.alias(n) for n, c in named.items()))


def ladder_closeness(c: Column, targets: list[str], ladder: list[str], steps: tuple[float, ...]) -> Column:
    """The best of steps by the distance between a value and a target on a ladder; 0 for what is not on it."""
    at = {name: i for i, name in enumerate(ladder)}
    place = F.coalesce(*(F.when(F.lower(F.trim(c)) == name, i) for name, i in at.items()), F.lit(None).cast("int"))
    best = [F.coalesce(*(F.when(F.abs(place - at[t]) == d, v) for d, v in enumerate(steps)), F.lit(0.0)) for t in targets if t in at]
    return F.greatest(*best) if len(best) > 1 else best[0] if best else F.lit(0.0)


def stem(w: Column) -> Column:
    """Small letters without a last ing, ed, es or s of longer words."""
    letters = F.regexp_replace(F.lower(w), "[^a-z]", "")
    return F.regexp_replace(letters, "^(.{3,}?)(?:ing|ed|es|s)$", "$1")


def stems(c: Column) -> Column:
    """Distinct stems of two letters and more."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[\s,/&-]+"), stem), lambda w: F.length(w) > 1))


def function_overlap(c: Column, targets: list[str]) -> Column:
    """1.5 times the best Jaccard similarity of the stems of a value and of a target, 1 at most."""
    # An array of one element binds the stems, so that they are made once a row.
    bound = F.array(F.struct(stems(c).alias("mine"), *(stems(F.lit(t)).alias(f"t{i}") for i, t in enumerate(targets))))

    def closest(s: Column) -> Column:
        alike = [F.size(F.array_intersect(s["mine"], s[f"t{i}"])) / F.greatest(F.lit(1), F.size(F.array_union(s["mine"], s[f"t{i}"]))) for i in range(len(targets))]
        scores = [F.coalesce(x, F.lit(0.0)) for x in alike]
        return F.greatest(*scores) if len(scores) > 1 else scores[0]

    return F.least(F.lit(1.0), F.transform(bound, closest)[0] * 1.5)


def industry_closeness(c: Column, targets: list[str], parents: dict[str, list[str]]) -> Column:
    """1 for a target, 0.7 for an industry one of whose parents is a target."""
    below = [name for name, up in parents.items() if set(up) & set(targets)]
    return F.when(F.exists(c, lambda x: F.lower(x).isin(targets)), 1.0).when(F.exists(c, lambda x: F.lower(x).isin(below)) if below else F.lit(False), 0.7).otherwise(0.0)


def size_closeness(staff: Column, low: float | None, high: float | None) -> Column:
    """1 inside, 0.5 within half the nearer bound of it, else 0; 0 where unknown."""
    if low is None and high is None:
        return F.lit(0.0)
    a, b = low or 0, high if high is not None else math.inf
    off = F.when(staff < a, (a - staff) / max(1, a)).otherwise((staff - b) / max(1, b))
    return F.when(staff.isNull(), 0.0).when((staff >= a) & (staff <= b), 1.0).when(off <= 0.5, 0.5).otherwise(0.0)


def geo_closeness(lat: Column, lon: Column, centre: tuple[float, float], radius: float) -> Column:
    """e to the minus distance over radius (km); 0 where unknown."""
    return F.coalesce(F.exp(-haversine(F.lit(centre[0]), F.lit(centre[1]), lat, lon) / max(1.0, radius)), F.lit(0.0))


def weighted_mean(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """The weighted mean of parts and the names of the three that add most, in order; ties as they stand."""
    mean = total(c * w for c, w in parts.values()) / sum(w for _, w in parts.values())
    entries = F.array(*(F.struct((-c * w).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, (c, w)) in enumerate(parts.items())))
    return mean, F.array_join(F.transform(F.slice(F.array_sort(entries), 1, 3), lambda e: e["n"]), ",")


def _percent(c: Column) -> Column:
    return clamp(F.coalesce(c.cast("double"), F.lit(0.0)), 0.0, 100.0)


def overlay(audience: str, project: dict) -> Column:
    """What one audience looks for in a candidate, 0 to 100.

    customer: intent, recent (signals); investor: stages, sectors, check_min, check_max against the project's status, industries and
    funding target; partner: is_competitor, shared_icp; hire: shared_industries, seniority_match; design_partner: a customer's, and early_adopter.
    """
    customer = 0.6 * _percent(F.col("intent")) + 0.4 * _percent(F.least(F.coalesce("recent", F.lit(0)), F.lit(10)) * 10)
    if audience == "customer":
        return customer
    if audience == "design_partner":
        return 0.6 * customer + 0.4 * _percent(F.col("early_adopter"))
    if audience == "partner":
        return 0.5 * F.when(F.coalesce("is_competitor", F.lit(False)), 0.0).otherwise(100.0) + 0.5 * _percent(F.least(F.coalesce("shared_icp", F.lit(0)), F.lit(5)) * 20)
    if audience == "hire":
        return 0.5 * _percent(F.least(F.coalesce("shared_industries", F.lit(0)), F.lit(3)) * 33) + 0.5 * F.when(F.coalesce("seniority_match", F.lit(False)), 100.0).otherwise(40.0)
    none = F.array().cast("array<string>")
    stages, sectors, wanted = F.coalesce("stages", none), F.coalesce("sectors", none), project["industries"]
    stage = F.when(F.array_contains(stages, project["status"]) if project.get("status") else F.lit(False), 100.0).when(F.size(stages) > 0, 30.0).otherwise(50.0)
    sector = 100.0 * F.size(F.array_intersect(F.array(*map(F.lit, wanted)), sectors)) / len(wanted) if wanted else F.lit(50.0)
    ideal = project.get("funding_target", 0) / 10
    low, high = F.col("check_min"), F.col("check_max")
    off = F.when(low > ideal, (low - ideal) / low).otherwise((ideal - high) / high)
    check = F.when((low > 0) & (high > 0), F.when((low <= ideal) & (high >= ideal), 100.0).otherwise(100 - clamp(off) * 100)).otherwise(50.0) if ideal > 0 else F.lit(50.0)
    return 0.4 * stage + 0.3 * sector + 0.3 * F.coalesce(check, F.lit(50.0))


AUDIENCES = ("customer", "investor", "partner", "hire", "design_partner")


def audience_fit(persona: Column, cosine: Column, audience: str, project: dict) -> Column:
    """0.4 of a persona score, 0.4 of a cosine (0.45 is 0, 0.85 is 100) and 0.2 of the audience's overlay."""
    semantic = _percent((cosine - 0.45) / 0.4 * 100)
    return clamp(0.4 * _percent(persona) + 0.4 * semantic + 0.2 * overlay(audience, project), 0.0, 100.0)
