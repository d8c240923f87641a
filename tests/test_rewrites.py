"""Rewrites that keep a task's share bounded: against Spark's own results, DuckDB's SQL and literal values."""

import duckdb
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans import rewrites
from tidemark.plans.rewrites import medians


def test_exact_medians(spark):
    """Where Spark's own exact median is the measure: ties, NaN, negative numbers, one row, two rows, a null key, no value."""
    nan = float("nan")
    rows = [("tied", 5.0)] * 50 + [("odd", -float(x * 7919 % 1001)) for x in range(1001)] + [("even", float(x * 7919 % 1000)) for x in range(1000)] + [("one", 3.0), ("two", 1.0), ("two", 4.0), (None, 2.0), (None, 8.0), (None, None), ("none", None)] + [("nan", nan)] * 3 + [("nan", 1.0)] * 3 + [("zero", -0.0), ("zero", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r.k: (r.m + 0.0, r.x + 0.0) for r in df.filter("v IS NOT NULL").groupBy("k").agg(F.percentile_approx("v", 0.5, 10000).alias("m"), F.median("v").alias("x")).collect()}
    found = {r.k: (r.m + 0.0, r.x + 0.0) for r in medians(df, "k", "v", "m", "x").collect()}
    assert repr(sorted(found.items(), key=str)) == repr(sorted(want.items(), key=str))


def test_exact_medians_outside_the_bracket(spark, monkeypatch):
    """Bounds that miss the middle cost more rows, not the result."""
    df = spark.createDataFrame([(k, float(v * 37 % 101 + k)) for k in (1, 2) for v in range(100 + k)], "k int, v double")
    want = df.groupBy("k").agg(F.median("v").alias("x")).collect()
    for bracket in ((0.6, 0.7, 0.8), (0.1, 0.2, 0.3)):
        monkeypatch.setattr(rewrites, "BRACKET", bracket)
        assert {r.k: r.x for r in medians(df, "k", "v", "m", "x").collect()} == {r.k: r.x for r in want}


def test_approximate_aggregates(spark, tmp_path):
    """One plan held an exact median and a distinct count, with buffers for each pair of flag and order; negative and absent prices failed."""
    rows = [("A", k, -1.0 - k) for k in range(9)] + [("N", k, None) for k in range(5)] + [(None, 1, 2.0), ("R", None, 4.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["ext_approximate_aggregates"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == [("A", True, True), ("N", True, True), ("R", True, True), (None, True, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and " median(" not in plan
    assert not any("count(distinct" in x for x in plan.splitlines())


def test_lateral_takes_each_customers_best_order(spark, tmp_path):
    """Orders of absent customers and of none count; the order within a customer is the SQL's, however rows are dealt."""
    customers, nan = 40, float("nan")
    rows = [(k, k * 7 % customers, float(k * 7919 % 1009)) for k in range(4000)] + [(5000, 99, 1.0), (5001, None, 1.0), (5002, None, 2.0), (5003, 98, None), (5004, 98, nan), (5005, 97, 3.0), (None, 97, 3.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(customers)] + [(0,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.queries()["ext_lateral"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert found.columns == ["c_custkey", "o_orderkey"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(registry.oracle_sql()["ext_lateral"]).fetchall(), key=str)
    ranks = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window [row_number()" in x]
    assert ranks and all("o_totalprice" in x for x in ranks)


def test_row_numbers_by_ranges(spark, tmp_path, monkeypatch):
    """Many ranges, ties of the first key across them, null keys last as in the SQL; no task sorts the table."""
    rows = [(k * 7919 % 3001, f"{k % 5}-P") for k in range(3001)] + [(None, "1-P"), (None, None), (4001, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(rewrites, "TASK_ROWS", 100)
    found = registry.queries()["sort_multi_key_null_order"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert found.columns == ["o_orderkey", "place"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(registry.oracle_sql()["sort_multi_key_null_order"]).fetchall(), key=str)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
