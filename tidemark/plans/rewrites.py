"""Quantified comparisons, full sub-query semantics and recursion with duplicates removed, as DataFrame plans."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare_any(left: Column, op: str, bounds: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """`left op ANY (SELECT column ...)` as a one-row table to cross-join and a condition; NULLs make it unknown.

    `=` is a semi join's business: see equal_any. `<> ANY` holds unless all values are the one compared.
    """
    stats = bounds.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n"), F.count(column).alias("_k"))
    if op == "<>":
        hit = (left != F.col("_lo")) | (left != F.col("_hi"))
    else:
        hit = _apply(left, op, F.col({">": "_lo", ">=": "_lo", "<": "_hi", "<=": "_hi"}[op]))
    return stats, F.when(F.col("_n") == 0, F.lit(False)).when(hit, F.lit(True)).when((F.col("_n") > F.col("_k")) | left.isNull(), F.lit(None)).otherwise(F.lit(False))


def compare_all(left: Column, op: str, bounds: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """`left op ALL (SELECT column ...)`: true over no rows."""
    stats = bounds.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n"), F.count(column).alias("_k"))
    if op == "=":
        hit = (left == F.col("_lo")) & (left == F.col("_hi"))
    else:
        hit = _apply(left, op, F.col({">": "_hi", ">=": "_hi", "<": "_lo", "<=": "_lo"}[op]))
    return stats, F.when(F.col("_n") == 0, F.lit(True)).when(~hit, F.lit(False)).when((F.col("_n") > F.col("_k")) | left.isNull(), F.lit(None)).otherwise(F.lit(True))


def equal_any(df: DataFrame, left: str, values: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column `name`: left = ANY (values), which is IN; its NOT is <> ALL. Three-valued as in SQL.

    The distinct values are joined by equality and the counts of rows and NULLs are one row.
    """
    stats = values.agg(F.count("*").alias("_n"), F.count(column).alias("_k"))
    found = values.select(F.col(column).alias("_v")).dropna().distinct().withColumn("_hit", F.lit(True))
    verdict = F.when(F.col("_n") == 0, F.lit(False)).when(F.col("_hit"), F.lit(True)).when(F.col(left).isNull() | (F.col("_n") > F.col("_k")), F.lit(None)).otherwise(F.lit(False))
    return df.join(found, F.col(left) == F.col("_v"), "left").crossJoin(F.broadcast(stats)).withColumn(name, verdict).drop("_v", "_hit", "_n", "_k")


def _apply(a: Column, op: str, b: Column) -> Column:
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def recursive_distinct(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION DISTINCT: step maps the newest rows to the next ones, rows seen before are dropped.

    Each round's rows are checkpointed, so the plan stays short and a lost executor costs one round at most.
    """
    spark = anchor.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))  # the latter in tests only
    seen = frontier = anchor.distinct().checkpoint()
    for _ in range(limit):
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in anchor.columns]
        frontier = step(frontier).toDF(*anchor.columns).distinct().alias("n").join(seen.alias("s"), same, "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier).checkpoint()
    raise RuntimeError(f"the recursion goes on after {limit} rounds")


#: Rows of a task where a plan deals them out by number: a task's memory then doesn't grow with the table.
TASK_ROWS = 2_000_000


def tasks(df: DataFrame) -> int:
    """How many tasks to deal df's rows to; they are counted, which of a Parquet table reads the footers only."""
    return df.count() // TASK_ROWS + 1


#: Shares between which the exact median is looked for, around percentile_approx's 0.5; its error is a 10,000th of the rows.
BRACKET, ACCURACY = (0.4995, 0.5, 0.5005), 10000


def medians(df: DataFrame, key: str, value: str, near: str, exact: str) -> DataFrame:
    """percentile_approx and the exact median of a number for each key that has one; no task gathers a key's values.

    Two percentiles near the middle part a key's values in three. Counts tell which parts the middle ranks are in (the
    inner one; any, should the sketch err), and only the different values of those are put in order. There is a row a
    key in the broadcasts, so keys must be few.
    """
    v, low, high = F.col("_v"), F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    rows = df.select(F.col(key), F.col(value).alias("_v")).filter(v.isNotNull())
    bounds = rows.groupBy(key).agg(F.percentile_approx("_v", list(BRACKET), ACCURACY).alias("_p"), F.count("*").alias("_n"))
    bounds = bounds.select(key, *(F.col("_p")[i].alias(n) for i, n in enumerate(("_from", near, "_to"))), "_n")

    def beside(t: DataFrame) -> DataFrame:
        t = t.withColumnRenamed(key, "_key")
        return rows.join(F.broadcast(t), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")

    parts = beside(bounds).groupBy(*bounds.columns).agg(F.count_if(v < F.col("_from")).alias("_a"), F.count_if(v <= F.col("_to")).alias("_b"))
    before = F.when(v < F.col("_from"), F.lit(0)).when(v <= F.col("_to"), F.col("_a")).otherwise(F.col("_b"))
    upto = F.when(v < F.col("_from"), F.col("_a")).when(v <= F.col("_to"), F.col("_b")).otherwise(F.col("_n"))
    held = beside(parts).withColumn("_before", before).filter((F.col("_before") < high) & (upto >= low))
    held = held.groupBy(key, near, "_n", "_before", "_v").agg(F.count("*").alias("_c"))
    held = held.withColumn("_last", F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "_before").orderBy("_v")))
    share = sum(((F.col("_last") - F.col("_c") < r) & (r <= F.col("_last"))).cast("int") for r in (low, high))
    return held.withColumn("_s", share / 2).filter("_s > 0").groupBy(key, near).agg(F.sum(v * F.col("_s")).alias(exact))
