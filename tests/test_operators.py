"""Operators on small tables, edge cases included."""

import math

from pyspark.sql import functions as F

from ledgerline.functions import numbers, text
from ledgerline.functions.arrays import jaccard, union_ignoring_case
from ledgerline.operators import funds, graph, identity, joins, metrics, search, sequences
from ledgerline.sources import files


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rounding_and_percentiles(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    found = df.agg(*(numbers.discrete_percentile(F.col("x"), 0.5, r).alias(r) for r in numbers.RULES)).first()
    assert (found.floor_nm1, found.floor_n, found.upper_median) == (2.0, 3.0, 3.0)
    assert df.filter("x > 9").agg(numbers.discrete_percentile(F.col("x"), 0.5, "floor_n").alias("v")).first().v is None
    assert one(spark, numbers.ratio(F.lit(1.0), F.lit(0.0))) == 0


def test_text(spark):
    assert one(spark, text.slug(F.lit("  Éléphant & Co. "))) == "elephant-co"
    assert one(spark, text.company_key(F.lit("Acme Holdings, Inc."))) == "acme holdings"
    assert one(spark, text.canonical_url(F.lit("http://www.Example.com//a/b/?utm_source=x&B=2&a=1#top"))) == "https://example.com/a/b?a=1&b=2"
    assert one(spark, text.luhn(F.lit("4539578763621486"))) and not one(spark, text.luhn(F.lit("4539578763621487")))
    assert one(spark, text.redact_pii(F.lit("a@b.io from 10.0.0.1"))) == "[email] from [ip]"
    assert [one(spark, text.money(F.lit(x))) for x in ("€1.2bn", "1.234,56", "N/A", None)] == [1.2e9, 1234.56, None, None]
    assert one(spark, text.strip_html(F.lit("<p>a &amp; b<script>x</script></p>"))) == "a & b"


def test_arrays(spark):
    assert one(spark, union_ignoring_case(F.array(F.lit("Red"), F.lit("blue")), F.array(F.lit("RED"), F.lit("Green")))) == ["Red", "blue", "Green"]
    empty = F.array().cast("array<string>")
    assert one(spark, jaccard(empty, empty)) == 0 and one(spark, jaccard(empty, empty, 1.0)) == 1


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold string, predicted string")
    assert values(metrics.per_class(df, "gold", "predicted"), "class", "tp", "fp", "fn") == [("a", 1, 1, 1), ("b", 1, 1, 0), ("c", 0, 0, 1)]
    assert metrics.macro(metrics.per_class(df, "gold", "predicted")).first().classes == 3
    sure = spark.createDataFrame([(0.0, 1), (1.0, 1)], "p double, y int")
    assert abs(metrics.probability_scores(sure, "p", "y").first().log_loss - -math.log(1e-9) / 2) < 1e-5


def test_near_in_time_crosses_buckets(spark):
    left = spark.sql("SELECT 1 AS id, 'k' AS k, timestamp'2024-01-01 23:59:00' AS ts UNION ALL SELECT 2, 'k', timestamp'2024-02-01'")
    right = spark.sql("SELECT 'k' AS k, timestamp'2024-01-02 00:01:00' AS u, 'x' AS v UNION ALL SELECT 'k', timestamp'2024-01-01', 'y'")
    assert values(joins.near_in_time(left, right, "k", "ts", "u", 1, "id"), "id", "v") == [(1, "x")]
    assert values(joins.without_near(left, right, "k", "ts", "u", 1, "id"), "id") == [(2,)]


def test_pairs_are_capped(spark):
    df = spark.createDataFrame([("g", i) for i in (3, 1, 2, 2)], "g string, m int")
    assert values(joins.pairs_within(df, "g", "m"), "a", "b") == [(1, 2), (1, 3), (2, 3)]
    assert values(joins.pairs_within(df, "g", "m", 2), "a", "b") == [(1, 2)]


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("c", "a", float("nan")), ("a", "d", 0.0), ("b", "e", 0.5)], "src string, dst string, weight double")
    ranks = dict(values(graph.pagerank(edges), "id", "rank"))
    assert set(ranks) == {"a", "b", "e"} and abs(sum(ranks.values()) - 1) < 1e-6
    assert graph.pagerank(edges.filter("weight < 0")).count() == 0


def test_broker(spark):
    bridge = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a int, b int, weight double")
    found = dict(values(graph.constraint(bridge), "id", "broker"))
    assert found[1] == 0 and abs(found[2] - 0.5) < 1e-9


def test_paths_are_simple(spark):
    edges = joins.undirected(spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.1)], "a int, b int, quality double"), "a", "b", "quality")
    found = graph.best_paths(edges, spark.createDataFrame([(1,)], "id int"), F.col("dst") == 3)
    assert [list(r.path) for r in found.orderBy("cost").collect()] == [[1, 2, 3], [1, 3]]


def test_logistic_needs_both_classes(spark):
    one_class = spark.range(30).select(F.rand(1).alias("x"), F.lit(1).alias("y"))
    assert graph.fit_logistic(one_class, ["x"], "y", epochs=1) is None
    both = spark.range(40).select((F.col("id") / 40).alias("x"), (F.col("id") > 20).cast("int").alias("y"))
    assert graph.fit_logistic(both, ["x"], "y", epochs=30)[1] > 0


def test_snapshot_steps(spark):
    rows = spark.createDataFrame([("c", 1, "x", 0.5), ("c", 1, "y", 0.5), ("c", 2, "x", 0.4), ("c", 2, "z", 0.6)], "c string, at int, who string, share double")
    assert values(funds.snapshot_steps(rows, ["c"], "at", "who", "share"), "who", "step") == [("x", "down"), ("y", "exited"), ("z", "entered")]


def test_flicker_is_no_change(spark):
    rows = spark.createDataFrame([("f", p, m) for m, ps in {"stays": (1, 2, 3, 4), "flickers": (1, 3, 4), "leaves": (1, 2)}.items() for p in ps], "f string, p int, m string")
    assert values(funds.member_changes(rows, ["f"], "p", "m", 1), "p", "m", "change") == [(3, "leaves", "left")]


def test_exit_proceeds_and_multiples(spark):
    p = lambda kind, mark=None: one(spark, funds.exit_proceeds(F.lit(kind), F.lit(10.0), F.lit(0.1), F.lit(500.0), F.lit(0.9), F.lit(mark).cast("double")))
    assert [p("ipo"), p("acquisition"), p("bankruptcy"), p("held"), p("held", 300.0)] == [50.0, 25.0, 0.0, 10.0, 30.0]
    assert spark.range(1).select(*funds.multiples(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))).first().tvpi is None


def test_identity_cascade(spark):
    new = spark.createDataFrame([(1, "a@x", None), (2, None, "f"), (3, None, None)], "id int, email string, firm string")
    known = spark.createDataFrame([(10, "a@x", "f", 1), (11, None, "f", 2)], "known int, email string, firm string, created int")
    found = identity.cascade(new, known, [("email", 1.0), ("firm", 0.75)], "id", "known", "created")
    assert values(found, "id", "known", "key") == [(1, 10, "email"), (2, 11, "firm")]


def test_identity_cascade_meets_one_known_row_a_key(spark):
    new = spark.createDataFrame([(i, None, "f") for i in range(20)] + [(20, "a@x", "f"), (21, "b@x", "g")], "id int, email string, firm string")
    known = spark.createDataFrame([(i, None, "f", i % 7) for i in range(30)] + [(30, "a@x", "f", None), (31, None, "g", None), (32, None, "g", None)], "known int, email string, firm string, created int")
    found = identity.cascade(new, known, [("email", 1.0), ("firm", 0.75)], "id", "known", "created")
    assert set(values(found, "id", "known", "key")) == {*((i, 6, "firm") for i in range(20)), (20, 30, "email"), (21, 31, "firm")}
    joins_ = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1:]
    assert len(joins_) == 2 and all("Window" in x for x in joins_)


def test_repoint_drops_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")
    canonical = spark.createDataFrame([(2, 1)], "id int, canonical_id int")
    assert values(identity.repoint(edges, canonical), "src", "dst") == [(1, 3)]


def test_search(spark):
    df = spark.createDataFrame([("Red bolt",), ("bolt",), ("Blue",)], "t string")
    assert values(df.filter(search.tokens_match(["bolt", "RED"], ["t"])), "t") == [("Red bolt",)]
    try:
        search.page(df, [F.col("t")], 0)
        raise AssertionError
    except ValueError:
        pass


def test_sequences(spark):
    rows = spark.createDataFrame([(1, i, i in (0, 1, 5)) for i in range(7)], "k int, at int, bad boolean")
    assert values(sequences.islands(rows, ["k"], ["at"], F.col("bad"), 2), "opened", "last_bad", "n_bad") == [(0, 1, 2), (5, 5, 1)]
    events = spark.sql("SELECT 1 AS k, timestamp_seconds(s) AS ts, s AS id, f AS failed FROM VALUES (0, true), (10, true), (20, false), (200, false) AS v(s, f)")
    assert [r.state for r in sequences.breaker(events, ["k"], "ts", "id", "failed", 2, 60, 100).orderBy("id").collect()] == ["closed", "closed", "open", "closed"]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;amount\r\n"Acme; Inc";12\r\n "multi\nline" ;7\r\n;\r\n')
    found = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert found.columns == ["name", "amount"] and values(found, "amount") == [("12",), ("7",)]
    (tmp_path / "b.tsv").write_text("1\t2\n3\t4\n")
    assert files.read_delimited(spark, str(tmp_path / "b.tsv")).columns == ["col_1", "col_2"]
    assert files.detect_format("x/y.CSV.gz") == "csv"


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', 1), (None, 2)], "a string, b int")
    files.export_csv(df, str(tmp_path / "out"))
    assert values(spark.read.csv(str(tmp_path / "out"), header=True, escape='"'), "a", "b") == [("say \"hi\", you", "1"), (None, "2")]
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    assert b"\r\n" in raw and b'"say ""hi"", you"' in raw


def test_keyed_writes(spark, tmp_path):
    schema = "k int, v int, w string"
    path = str(tmp_path / "t")
    files.upsert_table(spark, path, spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], schema), ["k"])
    files.upsert_table(spark, path, spark.createDataFrame([(2, 3, None), (3, 1, "c")], schema), ["k"], {"v": "greatest", "w": "keep_null"})
    assert values(spark.read.parquet(path), "k", "v", "w") == [(1, 5, "a"), (2, 5, "b"), (3, 1, "c")]
    old = spark.read.parquet(path)
    assert values(files.insert_ignore(old, spark.createDataFrame([(1, 0, "z"), (4, 0, "z"), (4, 1, "y")], schema), ["k"]), "k") == [(1,), (2,), (3,), (4,)]
    assert files.scan_or_empty(spark, str(tmp_path / "none"), old.schema).count() == 0


def test_upsert_holds_its_keys(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long, w string"
    files.upsert_table(spark, path, spark.createDataFrame([(1, 0, "old")], schema), ["k"])
    batch = spark.createDataFrame([(1, 3, None), (1, 2, "b"), (None, 1, "x"), (None, 4, "y"), (2, 5, "z")], schema)
    for how, expected in ((None, [(1, 3, None), (2, 5, "z"), (None, 4, "y")]), ({"w": "keep_null"}, [(1, 3, "b"), (2, 5, "z"), (None, 4, "y")])):
        for _ in range(2):  # a repeated batch changes nothing
            files.upsert_table(spark, path, batch, ["k"], how, ["v"])
            assert values(spark.read.parquet(path), "k", "v", "w") == sorted(expected, key=repr)
    files.upsert_table(spark, path, spark.createDataFrame([(1, 1, "first"), (1, 2, "last")], schema), ["k"], order=["v"])
    assert values(spark.read.parquet(path).filter("k = 1"), "v", "w") == [(2, "last")]
    ignored = files.insert_ignore(spark.createDataFrame([(None, 0, "old")], schema), batch, ["k"])
    assert values(ignored, "k", "v") == sorted([(None, 0), (1, 2), (2, 5)], key=repr)


def test_upsert_survives_a_crash(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k long, v long"
    files.upsert_table(spark, path, spark.createDataFrame([(1, 1), (2, 2)], schema), ["k"])
    move = files.TableFolder.move

    def crash(self, source, target):
        if ".new-" in source:
            raise KeyboardInterrupt
        move(self, source, target)

    monkeypatch.setattr(files.TableFolder, "move", crash)
    try:
        files.upsert_table(spark, path, spark.createDataFrame([(3, 3)], schema), ["k"])
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    assert not (tmp_path / "t").exists()
    files.upsert_table(spark, path, spark.createDataFrame([(4, 4)], schema), ["k"], create=False)
    assert values(spark.read.parquet(path), "k", "v") == [(1, 1), (2, 2), (4, 4)]
    try:
        files.upsert_table(spark, str(tmp_path / "other"), spark.createDataFrame([(4, 4)], schema), ["k"], create=False)
        raise AssertionError("a missing table was made")
    except FileNotFoundError:
        pass


def test_rebuild_converges(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "entity long, fact string"
    files.rebuild_table(spark, path, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], schema), ["entity"])
    for _ in range(2):
        files.rebuild_table(spark, path, spark.createDataFrame([(1, "e")], schema), ["entity"], spark.createDataFrame([(3,)], "entity long"))
        assert values(spark.read.parquet(path), "entity", "fact") == [(1, "e"), (2, "c")]


def test_feed_items(spark):
    pages = spark.createDataFrame([(1, "<rss><item><title><![CDATA[A & B]]></title><link>u</link></item><item><title>C</title></item></rss>")], "id int, xml string")
    assert values(files.feed_items(pages, "xml"), "title", "link") == [("A & B", "u"), ("C", "")]


def brute_spans(claims, sources):
    """The rules of the survey's verifier (D-26), over all pairs."""
    import re

    normal = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    keys = lambda s: [w for w in normal(s).split(" ") if len(w) > 1 and w not in text.STOPWORDS]
    found = set()
    for i, claim, span in claims:
        c, k = set(keys(claim)), keys(span)
        for d, source in sources:
            own = set(keys(source or ""))
            share = 1.0 if normal(span) in normal(source or "") else sum(w in own for w in k) / len(k) if k else 0.0
            if k and share >= 0.85:
                score = 0.0 if not c else 1.0 if c <= set(k) else len(c & set(k)) / len(c | set(k))
                found.add((i, d, normal(span) in normal(source or ""), round(share, 6), round(score, 6), bool(c) and score >= 0.7))
    return found


def test_verify_spans_agrees_with_all_pairs(spark):
    import random

    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "of", "x"]
    phrase = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    tail = " ".join(f"late{i}" for i in range(60))
    claims = [(i, phrase(draw.randint(1, 12)), phrase(draw.randint(1, 20))) for i in range(60)]
    claims += [(100, "art", "Art"), (101, "late59", tail), (102, "the", tail), (103, "late1 other", tail), (104, "x", "of the"), (105, "w1 w2", "w1, w2")]
    sources = [(i, ", ".join(phrase(draw.randint(1, 60)) for _ in range(2))) for i in range(60)]
    sources += [(1000, "a smart text"), (2000, "Far " + tail.replace(" ", "\n")), (2001, tail[:-60]), (2002, "cut1" + tail), (3000, None)]
    sources += [(4000 + i, f"before {s} after" if i % 2 else f"x{s}y") for i, (_, _, s) in enumerate(claims)]
    found = search.verify_spans(spark.createDataFrame(claims, "item_id long, claim string, span string"), spark.createDataFrame(sources, "doc_id long, text string"))
    rows = [(r.item_id, r.doc_id, r.contained, round(r.share, 6), round(r.score, 6), r.verified) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_spans(claims, sources)
    assert {(100, 1000), (101, 2000), (101, 2002)} <= {r[:2] for r in rows}


def test_spans_are_verified_in_all_documents(spark):
    from ledgerline.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    claims = [(r.item_id, r.text, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    sources = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {(r.item_id, r.doc_id, r.contained) for r in QUERIES["span_verify"](spark, folder).collect()}
    assert found == {r[:3] for r in brute_spans(claims, sources)} and any(d >= 40 for _, d, _ in found)


def test_spans_meet_only_texts_that_can_hold_them(spark):
    rare = " ".join(f"rare{i}" for i in range(20))
    claims = [(1, rare, rare), (2, "kelvin", "Kelvin in Diyar is \u212aelvin in Diyar"), (3, "b", "of b")]
    # 300 texts with some of a span's rarest words, which hold too little of it; the others hold it, in odd letters too, and one id has two texts.
    sources = [(i, " ".join(f"rare{j}" for j in range(i % 5, i % 5 + 8)) + " word" * 50) for i in range(300)]
    sources += [(1000, rare.upper()), (1000, "not so"), (1001, "x" + rare + "y"), (1002, "KEL\u212a \u212aELVIN IN D\u0130YAR, is kelvin in d\u0130 yar"), (1003, "\u212aELVIN IN DIYAR IS kelvin-in DIYAR \u1e9e\u03a3"), (1004, None)]
    texts = spark.createDataFrame(sources, "doc_id long, text string")
    found = search.verify_spans(spark.createDataFrame(claims, "item_id long, claim string, span string"), texts)
    rows = [(r.item_id, r.doc_id, r.contained, round(r.share, 6), round(r.score, 6), r.verified) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_spans(claims, sources) and {(1, 1000), (1, 1001), (2, 1003)} == {r[:2] for r in rows}
    words = rare.split(" ")
    spans = spark.createDataFrame([(1, words, words[1:-1])], "item_id long, k array<string>, inner array<string>")
    assert {(r.item_id, r.doc_id) for r in search.span_candidates(spans, texts, 0.85).collect()} == {(1, 1000), (1, 1001)}


def test_graph_queries_see_all_pairs(spark):
    from ledgerline.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    lines, sector = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().toPandas(), {r.s_suppkey: r.s_nationkey % 5 for r in spark.read.parquet(f"{folder}/supplier.parquet").collect()}
    joined = lines.merge(lines, on="l_orderkey")
    pairs = {(a, b) for a, b in zip(joined.l_suppkey_x.tolist(), joined.l_suppkey_y.tolist(), strict=True) if a != b}
    assert {(r.src, r.degree) for r in QUERIES["neighbours_bidirectional"](spark, folder).collect()} == {(a, sum(x == a for x, _ in pairs)) for a, _ in pairs}
    ranked = {r.id for r in QUERIES["sector_pagerank"](spark, folder).collect()}
    assert ranked and ranked == {a for a, b in pairs if sector[a] == sector[b]}
