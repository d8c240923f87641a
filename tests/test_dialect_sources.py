import pytest
from pyspark.sql import functions as F

from tidemark.dialect import translate
from tidemark.plans.rewrites import compare_all, compare_any
from tidemark.sources.delimited import into_outfile, into_variables, load_data


@pytest.mark.parametrize("text, made", [
    ("SELECT `a b`, \"it's\" FROM t LIMIT 2, 3", "SELECT `a b`, 'it\\'s' FROM t LIMIT 3 OFFSET 2"),
    ("SELECT 'a && b' FROM DUAL", "SELECT 'a && b'"),
    ("SELECT IF(IF(a, 1, 2) > 1, LENGTH(b), 0) FROM t", "SELECT CASE WHEN CASE WHEN (a) <> 0 THEN 1 ELSE 2 END > 1 THEN octet_length(b) ELSE 0 END FROM t"),
    ("SELECT a FROM t HAVING a > 1 LIMIT 1", "SELECT * FROM (SELECT a FROM t) AS _h WHERE a > 1 LIMIT 1"),
    ("SELECT 0xFF", "SELECT X'FF'"),
])
def test_translate(text, made):
    assert translate(text) == made


def test_assignments_are_refused():
    with pytest.raises(ValueError):
        translate("SELECT @a := @a + 1 FROM t")


def test_quantified_with_nulls(spark):
    bounds = spark.createDataFrame([(1,), (None,), (5,)], "b int")
    x = spark.createDataFrame([(0,), (3,), (9,)], "x int")
    one, any_ = compare_any(F.col("x"), ">", bounds, "b")
    assert [r.c for r in x.crossJoin(one).select("x", any_.alias("c")).orderBy("x").collect()] == [None, True, True]
    one, all_ = compare_all(F.col("x"), ">", bounds, "b")
    assert [r.c for r in x.crossJoin(one).select("x", all_.alias("c")).orderBy("x").collect()] == [False, False, None]


def test_load_with_prefix_and_skipped_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text('head\nhead\n>>1;"a;b";\\N\n>>2;c;7\nno prefix;x;1\n')
    df = load_data(spark, f"file://{tmp_path}/in.txt", "k int, s string, n int", sep=";", quote='"', line_start=">>", skip=2, set_={"t": F.col("k") * 10})
    assert sorted(map(tuple, df.collect())) == [(1, "a;b", None, 10), (2, "c", 7, 20)]


def test_outfile_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x y", None), (2, None, 2.5)], "a int, b string, c double")
    into_outfile(df, f"file://{tmp_path}/out", sep=",")
    assert sorted(map(tuple, load_data(spark, f"file://{tmp_path}/out", "a int, b string, c double", sep=",").collect())) == [(1, "x y", None), (2, None, 2.5)]


def test_into_variables(spark):
    assert into_variables(spark.range(1).toDF("v")) == {"v": 0}
    assert into_variables(spark.range(0).toDF("v")) == {"v": None}
    with pytest.raises(ValueError):
        into_variables(spark.range(2))
