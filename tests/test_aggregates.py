"""Aggregates whose results are cut from sums."""

from ledgerline.plans.catalog import QUERIES


def test_whole_units_of_exact_sums(spark, tmp_path):
    rows = [(1, 1, k, 0.1, 0.1, "N") for k in range(10)] + [(2, 1, 1, 5.0, 0.0, "R"), (3, 1, 1, None, 0.1, "R")]  # ten times 0.1 ends below 1 in doubles
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_tax double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.l_suppkey: r for r in QUERIES["investor_rollup"](spark, str(tmp_path)).collect()}
    assert (found[1].deployed, found[1].mean_check, found[2].deployed, found[2].mean_check) == (1, 0, 5, None)
    assert (found[3].deployed, found[3].mean_check) == (None, None)
