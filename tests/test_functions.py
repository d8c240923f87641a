"""Literal expectations for rules that the dialect has and DuckDB lacks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import conditional as C
from tidemark.functions import fulltext as X
from tidemark.functions import jsons as J
from tidemark.functions import maths as M
from tidemark.functions import strings as S
from tidemark.functions import temporal as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize("mode, week", [(0, 7), (1, 8), (2, 7), (3, 8), (4, 8), (5, 7), (6, 8), (7, 7)])
def test_week_of_2008_02_20(spark, mode, week):
    assert one(spark, T.week(day("2008-02-20"), mode)) == week


@pytest.mark.parametrize("mode, week", [(0, 0), (1, 1), (2, 52), (3, 1), (5, 0), (7, 53)])
def test_week_at_a_years_start(spark, mode, week):
    assert one(spark, T.week(day("2008-01-01"), mode)) == week


def test_year_week(spark):
    assert one(spark, T.year_week(day("1987-01-01"))) == 198652


def test_month_ends(spark):
    a, b = F.lit("2024-01-31").cast("timestamp_ntz"), F.lit("2024-02-29").cast("timestamp_ntz")
    assert one(spark, T.timestamp_diff("MONTH", a, b)) == 0
    assert one(spark, T.date_add(a, 1, "MONTH")) == dt.datetime(2024, 2, 29)
    assert one(spark, T.timestamp_diff("YEAR", b, a)) == 0


def test_date_format(spark):
    ts = F.lit("2009-10-04 22:23:00").cast("timestamp_ntz")
    assert one(spark, T.date_format(ts, "%W %M %Y")) == "Sunday October 2009"
    assert one(spark, T.date_format(ts, "%D %y %a %d %m %b %j")) == "4th 09 Sun 04 10 Oct 277"
    assert one(spark, T.date_format(ts, "%H %k %I %r %T %S %w")) == "22 22 10 10:23:00 PM 22:23:00 00 0"
    assert one(spark, T.date_format(F.lit("1999-01-01").cast("timestamp_ntz"), "%X %V")) == "1998 52"


def test_to_days_and_seconds(spark):
    assert one(spark, T.to_days(day("2007-10-07"))) == 733321
    assert one(spark, T.to_seconds(F.lit("2009-11-29 13:43:32").cast("timestamp_ntz"))) == 63426721412


def test_times_beyond_a_day(spark):
    assert one(spark, T.show_time(T.parse_time(F.lit("850:00:00")))) == "838:59:59"
    assert one(spark, T.parse_time(F.lit("10:61"))) is None
    assert one(spark, T.time_format(T.parse_time(F.lit("100:00:00")), "%H %k %h %I %l")) == "100 100 04 04 4"


def test_literals(spark):
    cases = [
        (S.substring(F.lit("hello"), 0, 2), ""), (S.substring(F.lit("hello"), -9, 2), ""), (S.pad(F.lit("hi"), -1, "?", True), None), (S.pad(F.lit("hi"), 4, "", False), ""), (S.insert(F.lit("Quadratic"), 3, 4, "What"), "QuWhattic"), (S.insert(F.lit("Quadratic"), -1, 4, "What"), "Quadratic"), (S.insert(F.lit("Quadratic"), 3, 100, "What"), "QuWhat"),
        (S.trim_string(F.lit("xxbarxx"), "x", "leading"), "barxx"), (S.quote(F.lit("Don't!")), "'Don\\'t!'"), (S.quote(F.lit(None).cast("string")), "NULL"), (S.export_set(F.lit(5), "Y", "N", ",", 4), "Y,N,Y,N"), (S.make_set(F.lit(5), "hello", "nice", "world"), "hello,world"), (S.soundex(F.lit("Quadratically")), "Q36324"), (S.ord_(F.lit("é")), 50089), (S.regexp_instr(F.lit("dog cat dog"), "cat"), 5),
        (M.bit_not(F.lit(5)).cast("string"), "18446744073709551610"), (M.truncate(F.lit(-1.999), 1), -1.9), (M.int_divide(F.lit(-5), F.lit(2)), -2), (M.int_divide(F.lit(2999999999), F.lit(1000000000)), 2), (M.int_divide(F.lit(7), F.lit(0)), None), (M.modulo(F.lit(5), F.lit(0)), None), (M.leading_number(F.lit("1e2x")), 100.0),
        (C.greatest(F.lit(1), F.lit(None).cast("int")), None), (C.interval(F.lit(23), 1, 15, 17, 30, 44, 200), 3), (C.interval(F.lit(None).cast("int"), 1), -1), (C.inet_aton(F.lit("10.0.5.9")), 167773449),
        (J.json_extract(F.lit('{"a": {"b": 1}, "c": [{"b": 2}]}'), "$**.b"), "[1, 2]"), (J.json_merge_preserve(F.lit("[1, 2]"), {"a": 3}), '[1, 2, {"a": 3}]'), (J.json_contains(F.lit('{"a": [1, {"x": 2}]}'), {"x": 2}, "$.a"), True), (J.json_search(F.lit('["abc", {"x": "abc"}]'), "all", "abc"), '["$[0]", "$[1].x"]'),
        (X.boolean_match(F.lit("apple pie with banana"), "+apple +(banana cherry) -kiwi"), True), (X.boolean_match(F.lit("apple pie"), "+apple -pie"), False), (X.boolean_match(F.lit("apple pie"), '"pie apple"'), False),
    ]
    row = spark.range(1).select(*(column.alias(f"x{i}") for i, (column, _) in enumerate(cases))).first()
    assert list(row) == [value for _, value in cases]


def test_json_table_raises_on_empty(spark):
    docs = spark.createDataFrame([(1, '[{"a": 1}, {}]')], "k int, doc string")
    kept = J.json_table(docs, "doc", "$[*]", J.PathColumn("a", "int", "$.a", on_empty=7))
    assert [r.a for r in kept.orderBy("a").collect()] == [1, 7]
    with pytest.raises(Exception, match="no value"):
        J.json_table(docs, "doc", "$[*]", J.PathColumn("a", "int", "$.a", on_empty=J.RAISE)).collect()


def test_relevance_without_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, ""), (4, "beta alpha")], "doc_id int, text string")
    assert [(r.doc_id, r.score) for r in X.search(docs, "doc_id", "text", "alpha").collect()] == [(1, 2 * X.BASE), (4, X.BASE)]
    assert X.search(docs, "doc_id", "text", "of").collect() == []


def test_group_concat_of_nothing(spark):
    found = spark.createDataFrame([(1, None), (2, "b"), (2, "a")], "k int, s string").groupBy("k").agg(S.group_concat(F.col("s"), [F.col("s")]).alias("g"))
    assert dict(found.collect()) == {1: None, 2: "a,b"}


def test_fractional_digits(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05.987654' AS ts")
    found = row.select(*(T.to_precision(F.col("ts"), d).cast("string").alias(str(d)) for d in (0, 1, 5, 6))).head()
    assert [v[19:] for v in found] == ["", ".9", ".98765", ".987654"]


def test_procedure_returns_its_last_result(spark):
    from tidemark.plans.routines import Routines

    r = Routines(spark)
    r.create("double_it", "n INT", "SELECT n * 2 AS m;")
    assert r.call("double_it", 21).head().m == 42
    with pytest.raises(ValueError):
        r.call("double_it")
    r.drop("double_it")
    with pytest.raises(KeyError):
        r.call("double_it", 1)


@pytest.mark.parametrize("query, score", [("alpha beta", 2.0), ("+alpha -beta", 0.0), (">alpha <beta", 2.5), ("~alpha", 0.0), ("gamma ~alpha", 0.0), ("beta ~alpha", 0.5), ("beta ~gamma", 1 + X.BASE), ("alp*", 2 * X.BASE), ('"beta alpha"', 1.0), ("+(alpha gamma) >beta", 3.0), ("+gamma alpha", 0.0), ("", 0.0), ("the", 0.0), ("~alpha <alpha", 0.001)])
def test_boolean_relevance(spark, query, score):
    assert one(spark, X.boolean_score(F.lit("Alpha, beta alpha the"), query)) == pytest.approx(score)
