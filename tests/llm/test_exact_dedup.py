import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup

ROWS = [(3, "a  b"), (1, "a\t\nb"), (2, "a b "), (4, None), (5, ""), (6, "a b"), (7, "é b"), (8, "x" * 5000), (9, "x" * 5000), (10, "x" * 4999 + "y"), (11, "a b")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return sorted((i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_groups(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in ROWS], "doc_id long, text string, size string")
    for kw in ({}, {"broadcast_groups": 0}, {"full_hash": lambda t: F.lit(1)}):
        assert sorted(map(tuple, exact_dedup(df, **kw).collect())) == brute(ROWS)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup(df).collect()
    assert len(got) == 5
    assert sum(r.kept for r in got) == 2
    assert [(r.keep_id, r.group_size) for r in got if r.kept] in ([(1, 3), (None, 2)], [(None, 2), (1, 3)])


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_has_no_python(spark, small):
    plan = exact_dedup(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
