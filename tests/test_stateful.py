"""Streams with several kinds of state, restarted from their checkpoints, give what the batch operators give; ticks fire once."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import sequences
from ledgerline.sources import files
from ledgerline.streaming import events as stream
from ledgerline.streaming import monitor, stateful

from .conftest import FOLDER


@pytest.fixture(scope="module")
def rows(spark):
    read = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # Fewer users fail more often.
    return read.select("event_id", (F.col("user_id") % 7).alias("user"), "ts", (F.col("event_type") == "error").alias("failed")).cache()


def in_three_runs(spark, rows, tmp_path, name, build):
    """Output of a query that is stopped twice and starts again from its checkpoint, each time with later rows."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [rows.agg(F.expr(f"percentile_approx(ts, {p})")).first()[0] for p in (0.3, 0.7)]
    edges = [None, *cuts, None]
    os.makedirs(source)
    for low, high in zip(edges, edges[1:]):
        part = rows.filter((F.col("ts") > F.lit(low)) if low else F.lit(True)).filter((F.col("ts") <= F.lit(high)) if high else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(source)
        read = stream.event_time(spark.readStream.schema(rows.schema).parquet(source), late="1 day")
        q = build(read).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def test_breaker(spark, rows, tmp_path):
    found = in_three_runs(spark, rows, tmp_path, "breaker", lambda r: stateful.breaker(r, "user", "ts", "event_id", "failed", 3, 6 * 3600, 2 * 3600))
    expected = sequences.breaker(rows, ["user"], "ts", "event_id", "failed", 3, 6 * 3600, 2 * 3600)
    a, b = ({r.event_id: r.state for r in x.collect()} for x in (found, expected))
    assert a == b and {"open", "closed"} == set(a.values())


def test_limit(spark, rows, tmp_path):
    found = in_three_runs(spark, rows, tmp_path, "limit", lambda r: stateful.fixed_window_limit(r, "user", "ts", "event_id", 3600, 2))
    expected = sequences.fixed_window_limit(rows, ["user"], "ts", "1 hour", 2, "event_id")
    a, b = ({r.event_id: r.allowed for r in x.collect()} for x in (found, expected))
    assert a == b and {True, False} == set(a.values())


def test_circuit():
    s = 1_000_000
    assert sequences.circuit([0, s, 2 * s, 3 * s, 50 * s], [True, True, True, False, True], [], None, 2, 10 * s, 5 * s) == (["closed", "closed", "open", "open", "closed"], [50 * s], 6 * s)


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_ticks_fire_once(spark, tmp_path):
    m = monitor.Monitor(spark, str(tmp_path / "m"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "entity string, at timestamp")
    fired = lambda: sorted((r.entity, r.at.minute, r.batch) for r in m.fired().collect())
    first = frame(("a", at(1)), ("b", at(2)), ("a", at(30)))
    assert m.tick(first, 0, at(10)) and fired() == [("a", 1, 0), ("b", 2, 0)]  # 00:30 is yet to come
    assert not m.tick(first, 0, at(10)) and len(fired()) == 2
    # A row that arrived while the tick ran is after the mark, one of before is not; a new entity has no mark.
    second = frame(("a", at(9)), ("a", at(11)), ("c", at(3)), ("a", at(30)))
    assert m.tick(second, 1, at(40)) and fired()[0:1] == [("a", 1, 0)] and set(fired()) >= {("a", 11, 1), ("a", 30, 1), ("c", 3, 1)} and ("a", 9, 1) not in fired()
    # A batch that stopped before its line of the ledger is done again from the same marks.
    m._write(frame(("a", at(50))), "fired", 2)
    third = frame(("a", at(41)), ("b", at(5)))
    assert m.tick(third, 2, at(60 - 1)) and {x for x in fired() if x[2] == 2} == {("a", 41, 2)}


def test_monitor_stream_replays(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", at(1)), ("b", at(2))], "entity string, at timestamp").write.parquet(source)
    for checkpoint in ("one", "one", "two"):  # the third begins anew, as after a lost checkpoint: batch 0 is in the ledger
        read = spark.readStream.schema("entity string, at timestamp").parquet(source)
        monitor.monitor_stream(read, str(tmp_path / "m"), str(tmp_path / checkpoint), lambda: at(10)).awaitTermination()
    assert monitor.Monitor(spark, str(tmp_path / "m")).fired().count() == 2


def test_only_touched_parts_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    files.upsert_parts(spark, path, spark.range(200).select("id", F.lit("old").alias("v")), ["id"], parts=16)
    names = lambda: {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.startswith("part")) for d in os.listdir(path) if d.startswith(files.PART_OF)}
    before = names()
    new = spark.createDataFrame([(7, "new"), (500, "new"), (7, "newer")], "id long, v string")
    for _ in range(2):  # writing a batch again changes nothing
        files.upsert_parts(spark, path, new, ["id"], {"v": "greatest"}, order=["v"])
        found = {r.id: r.v for r in spark.read.parquet(path).collect()}
        assert len(found) == 201 and found[500] == "new" and found[8] == "old" and found[7] == "old"
    changed = {d for d, f in names().items() if before.get(d) != f}
    assert 1 <= len(changed) <= 2 and len(before) == 16
    with pytest.raises(ValueError, match="parts"):
        spark.range(3).write.parquet(str(tmp_path / "plain"))
        files.upsert_parts(spark, str(tmp_path / "plain"), spark.range(3), ["id"])


def test_upsert_stream_by_parts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    rows = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("n"))
    rows.repartition(3).write.parquet(source)
    for _ in range(2):
        read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.upsert_stream(read, path, ["k"], str(tmp_path / "cp"), {"n": "greatest"}, parts=4).awaitTermination()
    assert {r.k: r.n for r in spark.read.parquet(path).collect()} == {k: 90 + k for k in range(10)}


def test_atom_feeds(spark):
    xml = """<feed><entry><title>One &amp; two</title><link rel="self" href="s"/><link href="https://x.example/1"/><id>u:1</id><updated>2024-01-02</updated><summary><![CDATA[Short]]></summary></entry>
<entry><title>Three</title><link rel="alternate" href="https://x.example/3"/><published>2024-01-03</published><content>Long</content></entry></feed>"""
    rss = "<rss><item><title>R</title><link>l</link><guid>g</guid><pubDate>d</pubDate><description>t</description></item></rss>"
    found = files.feed_items(spark.createDataFrame([(1, xml), (2, rss), (3, None), (4, "")], "id int, xml string"), "xml").collect()
    assert sorted(tuple(r) for r in found) == sorted([(1, "One &amp; two", "https://x.example/1", "u:1", "2024-01-02", "Short"), (1, "Three", "https://x.example/3", None, "2024-01-03", "Long"), (2, "R", "l", "g", "d", "t")], key=str)
