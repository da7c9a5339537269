"""Streams over small files give what the batch operators give."""

from pyspark.sql import functions as F

from ledgerline.operators import sequences
from ledgerline.streaming import events as stream

from .conftest import FOLDER


def load(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "user_id", "ts", "event_type", "value")


def run(spark, tmp_path, build, mode="append", parts=1):
    source = str(tmp_path / "in")
    load(spark).repartition(parts).write.parquet(source)
    rows = stream.event_time(spark.readStream.schema(load(spark).schema).parquet(source), late="60 days")
    q = build(rows).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql("SELECT * FROM out")


def test_window_counts(spark, tmp_path):
    found = run(spark, tmp_path, lambda r: stream.window_counts(r, ["event_type"], "1 day"), "complete")
    expected = stream.window_counts(load(spark), ["event_type"], "1 day")
    assert sorted((r.started, r.event_type, r.n) for r in found.collect()) == sorted((r.started, r.event_type, r.n) for r in expected.collect())


def test_first_only(spark, tmp_path):
    found = run(spark, tmp_path, lambda r: stream.first_only(r, ["user_id"]))
    assert found.count() == load(spark).select("user_id").distinct().count()


def test_suppress_repeats(spark, tmp_path):
    found = run(spark, tmp_path, lambda r: stream.suppress_repeats(r, "user_id", 3600))
    expected = sequences.suppress_repeats(load(spark), ["user_id"], "ts", "event_id", 3600)
    assert sorted((r.event_id, r.emitted) for r in found.collect()) == sorted((r.event_id, r.emitted) for r in expected.collect())


def test_incidents(spark, tmp_path):
    found = run(spark, tmp_path, lambda r: stream.incidents(r.withColumn("bad", F.col("event_type") == "error"), "user_id", "bad", 2))
    expected = sequences.islands(load(spark), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2)
    assert found.filter("change = 'opened'").count() == expected.count()


def test_upsert_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    load(spark).write.parquet(source)
    rows = stream.event_time(spark.readStream.schema(load(spark).schema).parquet(source))
    daily = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    for _ in range(2):
        stream.upsert_stream(daily, target, ["user_id"], str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).agg(F.sum("n")).first()[0] == load(spark).count()
