"""Cells, headers and layouts."""

import datetime

from pyspark.sql import functions as F

from ledgerline.functions import parsing
from ledgerline.sources import layouts


def each(spark, function, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in df.select("i", function(F.col("c")).alias("v")).orderBy("i").collect()]


def test_cells(spark):
    assert each(spark, parsing.percent, "12.5%", "12,5 %", "0.2", "40", "x", None) == [0.125, 0.125, 0.2, 0.4, None, None]
    assert each(spark, lambda c: parsing.year(c, 2026), "FY21", "'98", "founded 2014.", "1850", "2030", None) == [2021, 1998, 2014, None, None, None]
    day = datetime.date(2024, 3, 5)
    assert each(spark, parsing.date, "2024-03-05", "5/3/2024", "5 Mar 2024", "March 5, 2024", "soon") == [day] * 4 + [None]
    assert each(spark, lambda c: parsing.date(c, day_first=False), "3/5/2024") == [day]
    assert each(spark, parsing.stages, "Seed / Series A; angel", "unknown", None) == [["seed", "series_a"], [], None]
    assert each(spark, parsing.is_empty, "N/A", " ", "0", None) == [True, True, False, True]
    keys = each(spark, parsing.initial_key, "Catherine", "Kathryn", "Philip", "Filip", "Smith")
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] not in keys[:4]


def test_next_digest_over_a_clock_change(spark):
    now = spark.sql("SELECT timestamp'2024-03-30 12:00:00' AS now, 'Europe/Paris' AS zone")
    found = now.select(parsing.next_digest(F.col("now"), F.col("zone"), 9).alias("daily"), parsing.next_digest(F.col("now"), F.col("zone"), 9, "MON").alias("weekly")).first()
    assert found.daily == datetime.datetime(2024, 3, 31, 7) and found.weekly == datetime.datetime(2024, 4, 1, 7)


def test_overlap(spark):
    d = lambda s: F.lit(s).cast("date")
    found = spark.range(1).select(parsing.overlap_months(d("2020-01-01"), d("2021-01-01"), d("2020-07-01"), d("2022-01-01")).alias("a"), parsing.overlap_months(d("2020-01-01"), d("2020-02-01"), d("2021-01-01"), d("2022-01-01")).alias("b")).first()
    assert abs(found.a - 184 / 30.44) < 1e-9 and found.b == 0


def test_headers():
    found = layouts.map_headers(["Full Name", "E-Mail", "Compny", "Notes"])
    assert found["name"] == ("Full Name", 1.0) and found["email"][0] == "E-Mail" and found["org"][0] == "Compny" and "Notes" not in {h for h, _ in found.values()}


def test_text_table(spark):
    text = "Holdings as of March 31, 2024 (in thousands)\nFund          Committed   Paid\nAlpha Fund II     1,000      250\n\nBeta      20   30\nTotal\n"
    rows = layouts.text_table(spark.createDataFrame([(1, text)], "id int, text string"), "text", ["fund", "committed", "paid"]).collect()
    assert [(r.fund, r.paid, r.unit, r.as_of) for r in rows] == [("Alpha Fund II", "250", 1000, "March 31, 2024"), ("Beta", "30", 1000, "March 31, 2024")]


def test_xml_records(spark):
    xml = "<invs><inv><name>A</name><val>1</val></inv><inv><name>B</name></inv></invs>"
    rows = layouts.xml_records(spark.createDataFrame([(1, xml)], "id int, xml string"), "xml", "inv", {"name": "name", "value": "val"}).collect()
    assert [(r.id, r.name, r.value) for r in rows] == [(1, "A", "1"), (1, "B", None)]


def test_campaign(spark):
    people = spark.createDataFrame([("Ann B Lee", "a@x", None), ("Cher", "c@x", "Y")], "name string, email string, org string")
    rows = layouts.campaign(people, "split_names").collect()
    assert [tuple(r) for r in rows] == [("a@x", "Ann", "B Lee", ""), ("c@x", "Cher", "", "Y")]
    assert layouts.campaign(people, "crm").first()["Lead Source"] == "import"


def test_formats():
    from ledgerline.sources.files import detect_format

    assert [detect_format(*x) for x in (("a/b.CSV.gz",), ("https://x.io/data.tsv?x=.json#a",), ("https://x.io/export", "text/csv; charset=utf-8"), ("https://x.io/v1.2/list", "application/x-ndjson"), ("b", None), ("c.orc/",))] == ["csv", "csv", "csv", "json", "text", "orc"]


def test_json_array(spark, tmp_path):
    import json

    from ledgerline.sources.files import export_json_array

    path = str(tmp_path / "out")
    export_json_array(spark.range(1000).selectExpr("id", "if(id % 2 = 0, 'x', null) AS v").repartition(3), path)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(r["id"] for p in parts for r in p) == list(range(1000)) and all("v" in r for p in parts for r in p)
    export_json_array(spark.range(0).selectExpr("id"), path)
    assert all(p.read_text().strip() in ("", "[]") for p in (tmp_path / "out").glob("part-*"))
