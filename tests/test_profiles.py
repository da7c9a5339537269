"""Names, styles and keys against plain Python."""

import re
import unicodedata

from pyspark.sql import functions as F

from ledgerline.functions import style, text
from ledgerline.operators import identity, profiles, relations, triggers

from .test_operators import one, values


def plain_sound(w):
    s = re.sub("[^A-Z]", "", w.upper())
    for pattern, to in text.SOUNDS:
        s = re.sub(pattern, to.replace("$1", r"\1"), s)
    return (s[:1] + re.sub("[AEIOU]", "", s[1:]))[:6]


def plain_name(n):
    n = "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s'-]", " ", n)).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(a, b):
    best = 0.0
    for x in a["names"]:
        for y in b["names"]:
            x1, y1 = plain_name(x), plain_name(y)
            if x1 == y1 and x1:
                return 1.0
            u, v = ([w for w in re.split(r"[\s'-]+", n) if w and w not in text.TITLES] for n in (x1, y1))
            if not u or not v:
                continue
            su, sv = ([s for s in map(plain_sound, ws) if s] for ws in (u, v))
            sound = sum(s in set(sv) for s in su) / max(len(su), len(sv)) if su and sv else 0
            like = lambda p, q: sum(max(1 - edits(i, j) / max(len(i), len(j)) for j in q) for i in p) / len(p)
            best = max(best, 0.5 * sound + 0.25 * (like(u, v) + like(v, u)))
    if a["dob"] and b["dob"] and a["dob"] != b["dob"]:
        best *= 0.65
    if a["country"] and b["country"] and a["country"][:2].lower() != b["country"][:2].lower():
        best *= 0.85
    return best


def test_watchlist_by_brute_force(spark):
    asked = [("Dr. Jon Smyth", "1970-01-01", "GB"), ("Philippe Knight", None, "fr"), ("Élodie O'Brien", "1980", None), ("Wright Xavier Jr", None, "US"), ("", None, None), ("Thomas Schultz", "1990-02-03", "de")]
    listed = [("John Smith", "1970-01-01", "gb"), ("Filip Night", "1960", "FR"), ("Elodie Obrien", "1980", "ie"), ("Rite Zavier", None, "US"), ("Tomas Shulz", "1990-02-04", "at"), ("Jon Smyth", None, None), ("Ltd", None, None)]
    schema = "name string, dob string, country string"
    a = spark.createDataFrame([(i, n, d, c, ["Jane Smith"] if i == 0 else None) for i, (n, d, c) in enumerate(asked)], f"q long, {schema}, aliases array<string>")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], f"id long, {schema}")
    found = {(r.q, r.id): round(r.score, 6) for r in identity.watchlist(a, b, 0.55).collect()}
    expected = {}
    for i, (n, d, c) in enumerate(asked):
        for j, (m, e, f) in enumerate(listed):
            score = plain_match({"names": [n] + (["Jane Smith"] if i == 0 else []), "dob": d, "country": c}, {"names": [m], "dob": e, "country": f})
            if score >= 0.55:
                expected[i, j] = round(score, 6)
    assert found == expected and len(found) >= 4 and 1.0 not in {v for k, v in found.items() if k != (0, 5)}


def test_watchlist_scores_profiles_and_joins_people_last(spark):
    schema = "name string, dob string, country string"
    a = spark.createDataFrame([(i, "Jon Smyth", f"{1970 + i % 2}", None) for i in range(40)], f"q long, {schema}")
    b = spark.createDataFrame([(i, ["John Smith", "Jon Smyth"][i % 2], f"{1970 + i % 3}", "gb") for i in range(60)], f"id long, {schema}")
    found = identity.watchlist(a, b, 0.55)
    assert "Aggregate [q" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = {(i, j) for i in range(40) for j in range(60) if plain_match({"names": ["Jon Smyth"], "dob": f"{1970 + i % 2}", "country": None}, {"names": [["John Smith", "Jon Smyth"][j % 2]], "dob": f"{1970 + j % 3}", "country": "gb"}) >= 0.55}
    rows = [(r.q, r.id) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 1000


def test_style_by_brute_force(spark):
    texts = ["", "One day — we went (out), the end. Who? ME! https://x.io is up.\nIt's a well-known fact; so: what", "aaa AAA aaa 123 42\n\n", "Ünï çödé wörds… and \U0001f600 faces \U0001f680 and the day", "word " * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in style.vectors(rows).collect():
        t = texts[r.doc_id]
        words, low, n = re.findall(r"[^\W_](?:[\w'-]*[^\W_])?", t), t.lower(), max(1, len(t))
        k, lower = max(1, len(words)), [w.lower() for w in words]
        ends = max(1, len([x for x in re.split(r"[.!?]+\s+", t) if x]))
        syllables = sum(max(1, len(re.findall("[aeiouy]+", w))) for w in lower)
        expected = [low.count(c) / n for c in style.LETTERS] + [t.count(c) / n * 100 for c in style.MARKS] + [
            sum(map(len, words)) / k, k / ends, len(set(lower)) / k, sum(len(w) >= 7 for w in words) / k, sum(w == w.upper() and bool(re.search("[A-Z]", w)) for w in words) / k, sum("A" <= w[0] <= "Z" for w in words) / k,
            sum(c in "0123456789" for c in t) / n, t.count("https://") / k * 100, sum(ord(c) > 0x1F300 for c in t) / n, t.count("?") / ends, t.count("!") / ends, t.count("\n") / n * 100, syllables / k,
            sum(w in style.COMMON for w in lower) / k, sum(lower.count(w) == 1 for w in lower) / max(1, len(set(lower))), min(1, max(0, (206.835 - 1.015 * k / ends - 84.6 * syllables / k) / 100)),
        ]
        found = [r[name] for name in style.NAMES]
        assert all(abs(a - b) < 1e-9 for a, b in zip(found, expected, strict=True)), (t, [x for x in zip(style.NAMES, found, expected, strict=True) if abs(x[1] - x[2]) > 1e-9])


def test_keys(spark):
    assert [one(spark, text.phone_key(F.lit(x))) for x in ("+44 (20) 7946-0958", "555 010 1234", "1 555 010 1234", "12345", "+123", None)] == ["+442079460958", "+15550101234", "+15550101234", None, None, None]
    assert one(spark, text.canonical_url(F.lit("http://me:pw@www.X.io:8080/a?wickedid=1&b=2"))) == "https://x.io:8080/a?b=2"
    assert one(spark, text.canonical_url(F.lit("https://X.io:443/a/"))) == "https://x.io/a"
    assert one(spark, text.linkedin_key(F.lit("http://uk.LinkedIn.com/IN/Ada-L/?x=1"))) == "https://www.linkedin.com/in/ada-l" and one(spark, text.linkedin_key(F.lit("https://linkedin.com/feed"))) is None
    assert one(spark, text.handle_key(F.lit("https://x.com/@Ada?s=1"), "x.com", "twitter.com")) == "ada"
    assert one(spark, text.clamp_words(F.lit("  one two  three "), 2)) == "one two…" and one(spark, text.clamp_words(F.lit("one"), 2)) == "one"
    assert one(spark, text.sorted_json(F.lit('{"b": 1, "a": "x"}'))) == '{"a":"x","b":"1"}'
    assert [tuple(one(spark, text.money_range(F.lit(x)))) for x in ("$5-10m", "1m to 2m", "500k")] == [(5e6, 1e7), (1e6, 2e6), (5e5, 5e5)]
    assert [one(spark, text.in_usd(F.lit(x), {"eur": 1.1})) for x in ("€10k", "$5", "£3")] == [11_000.0, 5.0, None]
    assert one(spark, text.fund_key(F.lit("Acme Growth Fund III, L.P."))) == "acme growth 3"
    assert [plain_sound(w) for w in ("Knight", "Philippe", "Schmidt", "Xavier")] == [one(spark, text.metaphone(F.lit(w))) for w in ("Knight", "Philippe", "Schmidt", "Xavier")]


def test_stems(spark):
    assert [one(spark, profiles.stem(F.lit(w))) for w in ("Marketing", "ring", "traded", "boxes", "sales", "bus", "gas", "is")] == ["market", "ring", "trad", "box", "sal", "bus", "gas", "is"]


def test_edge_signals(spark):
    rows = spark.createDataFrame([("g1", 1, "2000-01-01"), ("g1", 2, "2001-06-01"), ("g2", 1, "1990-01-01"), ("g2", 2, "1991-01-01"), ("g3", 1, "2001-01-01"), ("g3", 3, None)], "g string, m long, seen string").withColumn("seen", F.col("seen").cast("date"))
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a long, b long")
    shared = relations.shared_signal(edges, rows, "g", "m", "seen", 10)
    assert values(shared, "a", "b") == [(1, 2), (1, 3)] and [str(r.seen) for r in shared.orderBy("b").collect()] == ["2001-06-01", "2001-01-01"]
    assert values(relations.mutual_signal(edges), "a", "b", "value") == [(1, 2, 1.0), (1, 3, 0.5), (2, 3, 0.5)]
    scored = relations.edge_scores(edges, {"co_investment_5y": shared, "mutual_jaccard": relations.mutual_signal(edges)}, F.lit("2003-01-15").cast("date"))
    assert values(scored, "a", "b", "signals") == [(1, 2, 2), (1, 3, 2), (2, 3, 1)]
    assert relations.baseline("board_member_at", "sec.form4.x") == 0.95 and relations.baseline("invested_in", "sec.form_d.1") == 0.95 and relations.baseline("advises", "?") == 0.7 and relations.baseline("none") == 0.5


def test_edges_in_many_cells(spark):
    import math
    import random

    draw = random.Random(4)
    ids = [i * i for i in range(3, 33)]  # uneven ranges
    pairs = sorted({tuple(sorted(draw.sample(ids, 2))) for _ in range(120)})
    rows = [(g, m, f"2001-{draw.randint(1, 12):02d}-01") for g in range(6) for m in draw.sample(ids, 12)]
    edges = relations.blocks(spark.createDataFrame(pairs, "a long, b long"), size=4, share=20)
    assert edges.cells.count() > 10 and edges.parts >= 6  # parts grow with the edges
    groups = spark.createDataFrame(rows, "g int, m long, seen string").withColumn("seen", F.col("seen").cast("date"))
    held, near = {m: {g: d for g, x, d in rows if x == m} for m in ids}, {m: {b if a == m else a for a, b in pairs if m in (a, b)} for m in ids}
    found = {(r.a, r.b): (round(r.value, 6), str(r.seen)) for r in relations.shared_signal(edges, groups, "g", "m", "seen", 10).collect()}
    common = lambda a, b: [max(held[a][g], held[b][g]) for g in held[a].keys() & held[b].keys()]
    assert {e: found[e] for e in pairs if e in found} == {e: (round(min(1, math.log1p(len(common(*e))) / math.log(11)), 6), max(common(*e))) for e in pairs if common(*e)}
    mutual = [(a, b, round(n / (len(near[a] | near[b]) - 2), 6)) for a, b in pairs if (n := len(near[a] & near[b]))]
    assert len(mutual) > 20 and sorted(values(relations.mutual_signal(edges).withColumn("value", F.round("value", 6)), "a", "b", "value")) == mutual
    scored = relations.edge_scores(edges, {"co_investment_5y": relations.shared_signal(edges, groups, "g", "m", "seen", 10)}, F.lit("2003-01-15").cast("date"))
    assert sorted(values(scored, "a", "b", "signals")) == [(*e, 1) for e in pairs if common(*e)]


def test_shared_counts_of_large_groups(spark):
    import random

    draw = random.Random(5)
    rows = [(g, m * m) for g in range(5) for m in draw.sample(range(30), 20)] + [(1, None), (None, 4)]
    twice = spark.createDataFrame(rows + rows, "g int, m int")
    held = {m: {g for g, x in rows if x == m and g is not None} for _, m in rows if m is not None}
    expected = sorted((a, b, n) for a in held for b in held if a < b and (n := len(held[a] & held[b])))
    assert sorted(values(relations.shared_counts(twice, "g", "m", size=4), "a", "b", "n")) == expected
    assert relations.shared_counts(twice.limit(0), "g", "m").count() == 0


def test_baseline_summaries_fire_nothing(spark):
    fields = "title string, role string, employer string, employer_id long, city string, country string, fit_max_score double, intent_score double, dd_risk_score double, dd_findings struct<low: int, medium: int, high: int, critical: int>, handles_count int"
    new = ("vp", None, "acme", 1, "x", "y", 50.0, None, 10.0, (0, 0, 1, 0), 2)
    old = ("vp", None, "acme", 1, "x", None, 44.0, None, 7.0, (0, 0, 0, 0), 2)
    rows = spark.createDataFrame([(1, None, new), (2, new, new), (3, old, new)], f"entity long, old struct<{fields}>, new struct<{fields}>")
    assert values(triggers.summary_triggers(rows), "entity", "kind") == [(3, "any_change"), (3, "dd_finding_new"), (3, "fit_score_change"), (3, "geo_change")]


def test_stems_cut_the_first_ending_and_are_made_once(spark):
    words = {"trading": "trad", "ring": "ring", "boxes": "box", "axes": "axe", "bed": "bed", "desks": "desk", "Marketed!": "market", "sing": "sing", "oxe": "oxe", "glasses": "glass"}
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", profiles.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in found} == words
    plan = spark.range(1).select(profiles.function_overlap(F.col("id").cast("string"), ["desk", "market"]))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 12  # the column's name repeats them


def test_feeds_of_one_entity_are_dealt_into_shares(spark):
    rows = spark.range(1000).select((F.col("id") % 1 + 7).alias("entity"), "id", F.timestamp_seconds(F.col("id") % 10).cast("timestamp_ntz").alias("at"))
    since = spark.range(0).select(F.col("id").alias("entity"), F.lit(None).cast("timestamp_ntz").alias("since"))
    found = triggers.feed_triggers({"new_post": rows}, since, 20)
    assert [tuple(r) for r in found.collect()] == [(7, "new_post", "999", 1000)]
    assert "salt" in found._jdf.queryExecution().analyzed().toString()
