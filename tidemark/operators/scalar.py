"""Queries over the function library: strings, arithmetic, time, conditionals, hashing and network functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import conditional as C
from tidemark.functions import maths as M
from tidemark.functions import strings as S
from tidemark.functions import temporal as T
from tidemark.plans.rewrites import compare_all, compare_any, equal_any, recursive_distinct
from tidemark.registry import op
from tidemark.session import table

c = F.col


def rows(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({names})")


# -- strings (2.10) -----------------------------------------------------------------------------------------------
@op("fn_string_concat_case_length", "SELECT c_custkey, c_name || '/' || c_mktsegment AS cc, concat_ws('-', c_name, NULL, c_mktsegment) AS ws, upper(c_mktsegment) AS up, lower(c_name) AS lo, strlen(c_name)::INT AS bytes, length(c_name)::INT AS chars, (strlen(c_name) * 8)::INT AS bits FROM customer")
def concat_case_length(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("cc"), F.concat_ws("-", "c_name", F.lit(None), "c_mktsegment").alias("ws"), F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("lo"), F.octet_length("c_name").alias("bytes"), F.char_length("c_name").alias("chars"), F.bit_length("c_name").alias("bits"))


_UNI = "('Ärger é'), ('abc'), (''), ('日本'), (NULL)"


@op("fn_string_bytes_unicode", f"SELECT s, CASE WHEN s IS NULL THEN NULL WHEN s = '' THEN 0 ELSE ('0x' || hex(encode(s))[1:2])::INT END AS first_byte, strlen(s)::INT AS n, hex(encode(s)) AS h, reverse(s) AS r FROM (VALUES {_UNI}) t(s)")
def bytes_unicode(spark, sf_dir):
    return rows(spark, _UNI, "s").select("s", S.first_byte(c("s")).alias("first_byte"), F.octet_length("s").alias("n"), F.hex(F.encode("s", "UTF-8")).alias("h"), F.reverse("s").alias("r"))


@op("fn_string_substring", "SELECT p_partkey, '' AS at0, substring(p_name, 2, 3) AS s23, substring(p_name, 4) AS from4, right(p_name, 3) AS neg3, '' AS short, left(p_name, 4) AS l4, right(p_name, 4) AS r4, '' AS l0 FROM part")
def substring(spark, sf_dir):
    n = c("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.substring(n, 0, 2).alias("at0"), S.substring(n, 2, 3).alias("s23"), S.substring(n, 4).alias("from4"), S.substring(n, -3).alias("neg3"), S.substring(n, 2, -1).alias("short"), S.left(n, 4).alias("l4"), S.right(n, 4).alias("r4"), S.left(n, -2).alias("l0"))


@op("fn_string_trim_pad_repeat", "SELECT n_nationkey, trim('  ' || n_name || ' ') AS t, ltrim('  ' || n_name) AS lt, rtrim(n_name || '  ') AS rt, regexp_replace('xyxy' || n_name || 'xy', '^(xy)+', '') AS lead, regexp_replace(n_name || 'xyxy', '(xy)+$', '') AS trail, left(lpad(n_name, 12, '*-'), 12) AS lp, left(rpad(n_name, 12, '*-'), 12) AS rp, left(n_name, 3) AS cut, repeat(n_name, 2) AS rep, '   ' AS sp, '' AS none FROM nation")
def trim_pad_repeat(spark, sf_dir):
    n = c("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.ltrim(F.concat(F.lit("  "), n)).alias("lt"), F.rtrim(F.concat(n, F.lit("  "))).alias("rt"), S.trim_string(F.concat(F.lit("xyxy"), n, F.lit("xy")), "xy", "leading").alias("lead"), S.trim_string(F.concat(n, F.lit("xyxy")), "xy", "trailing").alias("trail"), S.pad(n, 12, "*-", True).alias("lp"), S.pad(n, 12, "*-", False).alias("rp"), S.pad(n, 3, "x", True).alias("cut"), F.repeat(n, 2).alias("rep"), S.space(F.lit(3)).alias("sp"), S.space(F.lit(-3)).alias("none"))


@op("fn_string_replace_search", "SELECT p_partkey, replace(p_type, 'STANDARD', 'std') AS rp, instr(lower(p_name), 'a')::INT AS ins, instr(lower(p_type), 'n')::INT AS loc, (CASE WHEN instr(substring(lower(p_type), 5), 'n') > 0 THEN instr(substring(lower(p_type), 5), 'n') + 4 ELSE 0 END)::INT AS loc5, split_part(p_brand, '#', 1) AS si, reverse(split_part(reverse(p_brand), '#', 1)) AS sr, (CASE lower(p_brand) WHEN 'brand#11' THEN 1 WHEN 'brand#12' THEN 2 ELSE 0 END)::INT AS f FROM part")
def replace_search(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.replace("p_type", F.lit("STANDARD"), F.lit("std")).alias("rp"), S.instr_ci(c("p_name"), "A").alias("ins"), S.locate_ci("N", c("p_type")).alias("loc"), S.locate_ci("N", c("p_type"), 5).alias("loc5"), S.substring_index(c("p_brand"), "#", 1).alias("si"), S.substring_index(c("p_brand"), "#", -1).alias("sr"), S.field_ci(c("p_brand"), "BRAND#11", "BRAND#12").alias("f"))


@op("fn_string_insert_strcmp_sets", "SELECT n_nationkey AS k, CASE WHEN length(n_name) >= 3 THEN left(n_name, 2) || 'XX' || substring(n_name, 6) ELSE n_name END AS ins, CASE WHEN lower(n_name) < 'j' THEN -1 WHEN lower(n_name) = 'j' THEN 0 ELSE 1 END AS cmp, CASE WHEN n_nationkey = 1 THEN 'a' WHEN n_nationkey = 2 THEN 'b' WHEN n_nationkey = 3 THEN 'c' END AS e, concat_ws(',', CASE WHEN n_nationkey & 1 > 0 THEN 'x' END, CASE WHEN n_nationkey & 2 > 0 THEN 'y' END, CASE WHEN n_nationkey & 4 > 0 THEN 'z' END) AS ms, concat_ws('', CASE WHEN n_nationkey & 1 > 0 THEN 'Y' ELSE 'N' END, CASE WHEN n_nationkey & 2 > 0 THEN 'Y' ELSE 'N' END, CASE WHEN n_nationkey & 4 > 0 THEN 'Y' ELSE 'N' END) AS es, (CASE n_nationkey WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END)::INT AS fis FROM nation")
def insert_strcmp_sets(spark, sf_dir):
    k, n = c("n_nationkey"), c("n_name")
    return table(spark, sf_dir, "nation").select(k.alias("k"), S.insert(n, 3, 3, "XX").alias("ins"), S.strcmp_ci(n, F.lit("J ")).alias("cmp"), S.elt(k, "a", "b", "c").alias("e"), S.make_set(k, "x", "y", "z").alias("ms"), S.export_set(k, "Y", "N", "", 3).alias("es"), F.find_in_set(k.cast("string"), F.lit("3,7")).alias("fis"))


@op("fn_string_encode", "SELECT n_nationkey AS k, to_base64(encode(n_name)) AS b64, hex(encode(n_name)) AS hx, hex(n_nationkey) AS hn, bin(n_nationkey) AS b, md5(n_name) AS m, chr(65 + n_nationkey) AS ch, format('{:,.2f}', n_nationkey * 1234.5) AS f, '''' || n_name || '''' AS q FROM nation")
def encode(spark, sf_dir):
    k, n = c("n_nationkey"), c("n_name")
    return table(spark, sf_dir, "nation").select(k.alias("k"), S.to_base64(n).alias("b64"), F.hex(n).alias("hx"), F.hex(k).alias("hn"), F.bin(k).alias("b"), F.md5(n).alias("m"), F.decode(S.char(k + 65), "UTF-8").alias("ch"), S.format_number(k * 1234.5, 2).alias("f"), S.quote(n).alias("q"))


@op("fn_string_soundex_ord", "SELECT * FROM (VALUES ('Robertson', 'R16325', 82, '122'), ('Tymczak', 'T520', 84, '124'), ('Pfister', 'P236', 80, '120'), ('Lee', 'L000', 76, '114'), ('', '', 0, '0')) t(s, sx, o, oc)")
def soundex_ord(spark, sf_dir):
    s = c("s")
    return rows(spark, "('Robertson'), ('Tymczak'), ('Pfister'), ('Lee'), ('')", "s").select("s", S.soundex(s).alias("sx"), S.ord_(s).cast("int").alias("o"), S.octal(S.ord_(s)).alias("oc"))


@op("fn_regexp_functions", "SELECT c_custkey, regexp_matches(c_name, '#0+1')::INT AS rl, regexp_matches(c_name, '(?i)cust')::INT AS rli, regexp_replace(c_name, '[0-9]', 'd', 'g') AS rr, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS rs, (CASE WHEN regexp_matches(c_name, '[1-9]') THEN length(regexp_extract(c_name, '^[^1-9]*')) + 1 ELSE 0 END)::INT AS ri, c_name ILIKE '%MER#%' AS lk FROM customer")
def regexp_functions(spark, sf_dir):
    n = c("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", S.regexp_like(n, "#0+1").alias("rl"), S.regexp_like(n, "CUST", "i").alias("rli"), F.regexp_replace(n, "[0-9]", "d").alias("rr"), F.regexp_substr(n, F.lit("[1-9][0-9]*")).alias("rs"), S.regexp_instr(n, "[1-9]").alias("ri"), S.like(n, "%MER#%").alias("lk"))


# -- arithmetic, casts, bits (2.9), maths (2.11) ------------------------------------------------------------------
@op("op_arithmetic_zero_division", "SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / (o_orderkey % 5) END, 6) AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey // (o_orderkey % 5) END AS i, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % (o_orderkey % 5) END AS m, -o_custkey AS neg, o_custkey * 2 + 1 - 3 AS lin FROM orders")
def arithmetic(spark, sf_dir):
    k, z = c("o_orderkey"), c("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.round(M.divide(c("o_totalprice"), z), 6).alias("d"), M.int_divide(c("o_custkey"), z).alias("i"), M.modulo(c("o_custkey"), z).alias("m"), (-c("o_custkey")).alias("neg"), (c("o_custkey") * 2 + 1 - 3).alias("lin"))


@op("op_bits_unsigned", "SELECT k, ((18446744073709551615::UHUGEINT - k::UHUGEINT))::VARCHAR AS inv, ((k::UHUGEINT * 16) % 18446744073709551616::UHUGEINT)::VARCHAR AS l4, (k >> 2)::VARCHAR AS r2, k & 12 AS a, k | 3 AS o, xor(k, 5) AS x, bit_count(k)::INT AS n FROM (SELECT n_nationkey::BIGINT AS k FROM nation) t")
def bits(spark, sf_dir):
    k = c("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("k"), M.bit_not(k).cast("string").alias("inv"), M.shift_left(k, 4).cast("string").alias("l4"), M.shift_right(k, 2).cast("string").alias("r2"), k.bitwiseAND(F.lit(12)).alias("a"), k.bitwiseOR(F.lit(3)).alias("o"), k.bitwiseXOR(F.lit(5)).alias("x"), F.bit_count(k).alias("n"))


@op("op_cast_leading_number", "SELECT * FROM (VALUES ('12abc', 12.0::DOUBLE, 12::BIGINT), ('-3.5e2x', -350.0, -3), ('abc', 0.0, 0), ('  7 ', 7.0, 7), ('.5', 0.5, 0), (NULL, NULL, NULL)) t(s, d, i)")
def cast_leading_number(spark, sf_dir):
    return rows(spark, "('12abc'), ('-3.5e2x'), ('abc'), ('  7 '), ('.5'), (NULL)", "s").select("s", M.leading_number(c("s")).alias("d"), M.cast_signed(c("s")).alias("i"))


@op("op_cast_types", "SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12,1))::VARCHAR AS d, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS dt, CAST(o_orderkey AS DOUBLE) / 2 AS h, left(CAST(o_custkey AS VARCHAR), 2) AS c2 FROM orders")
def cast_types(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), c("o_totalprice").cast("decimal(12,1)").cast("string").alias("d"), c("o_orderkey").cast("string").alias("s"), c("o_orderdate").cast("date").alias("dt"), (c("o_orderkey").cast("double") / 2).alias("h"), F.left(c("o_custkey").cast("string"), F.lit(2)).alias("c2"))


@op("op_decimal_division_scale", "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(12,2))::DOUBLE / p_size, 6) AS DOUBLE) AS x FROM part")
def decimal_division(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.divide_decimal(c("p_retailprice").cast("decimal(12,2)"), c("p_size").cast("decimal(10,0)"), 2).cast("double").alias("x"))


@op("fn_math_rounding", "SELECT l_orderkey AS k, l_linenumber AS n, abs(-l_quantity) AS a, sign(l_discount - 0.05)::INT AS s, floor(-l_extendedprice / 7)::BIGINT AS f, ceil(l_extendedprice / 7)::BIGINT AS c, round(l_extendedprice, -2) AS r, (trunc(CAST(l_extendedprice AS DECIMAL(30,10)) * 10) / 10)::DOUBLE AS t1, (trunc(CAST(-l_extendedprice AS DECIMAL(30,10)) / 100) * 100)::DOUBLE AS t2 FROM lineitem")
def rounding(spark, sf_dir):
    p = c("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), F.abs(-c("l_quantity")).alias("a"), F.sign(c("l_discount") - 0.05).cast("int").alias("s"), F.floor(-p / 7).alias("f"), F.ceil(p / 7).alias("c"), F.round(p, -2).alias("r"), M.truncate(p, 1).alias("t1"), M.truncate(-p, -2).alias("t2"))


_X = "(CAST(-2.0 AS DOUBLE)), (-1.0), (-0.5), (0.0), (0.5), (1.0), (2.0), (10.0), (NULL)"


@op("fn_math_domains", f"SELECT x, round(CASE WHEN x >= 0 THEN sqrt(x) END, 9) AS sq, round(CASE WHEN x > 0 THEN ln(x) END, 9) AS l, round(CASE WHEN x > 0 THEN log2(x) END, 9) AS l2, round(CASE WHEN x > 0 THEN log10(x) END, 9) AS l10, round(CASE WHEN x > 0 THEN ln(x) / ln(3) END, 9) AS l3, round(CASE WHEN x BETWEEN -1 AND 1 THEN acos(x) END, 9) AS ac, round(CASE WHEN x BETWEEN -1 AND 1 THEN asin(x) END, 9) AS asn, round(CASE WHEN sin(x) <> 0 THEN cot(x) END, 9) AS ct FROM (VALUES {_X}) t(x)")
def domains(spark, sf_dir):
    x = c("x")
    fs = {"sq": M.sqrt(x), "l": M.ln(x), "l2": M.log2(x), "l10": M.log10(x), "l3": M.log(F.lit(3.0), x), "ac": M.acos(x), "asn": M.asin(x), "ct": M.cot(x)}
    return rows(spark, _X, "x").select("x", *(F.round(f, 9).alias(n) for n, f in fs.items()))


@op("fn_math_trigonometry", f"SELECT x, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(tan(x), 9) AS t, round(atan(x), 9) AS a, round(atan2(x, 2), 9) AS a2, round(degrees(x), 9) AS d, round(radians(x), 9) AS r, round(exp(x), 6) AS e, round(power(x, 3), 9) AS p, round(pi(), 9) AS pi FROM (VALUES {_X}) t(x)")
def trigonometry(spark, sf_dir):
    x = c("x")
    fs = {"s": (F.sin(x), 9), "c": (F.cos(x), 9), "t": (F.tan(x), 9), "a": (F.atan(x), 9), "a2": (F.atan2(x, F.lit(2.0)), 9), "d": (F.degrees(x), 9), "r": (F.radians(x), 9), "e": (F.exp(x), 6), "p": (F.pow(x, F.lit(3)), 9), "pi": (F.pi(), 9)}
    return rows(spark, _X, "x").select("x", *(F.round(f, n).alias(name) for name, (f, n) in fs.items()))


@op("fn_math_conversion", "SELECT n_nationkey AS k, upper(printf('%x', n_nationkey * 1000)) AS hx, bin(n_nationkey) AS b, printf('%o', n_nationkey) AS o, (length(replace(bin(n_nationkey), '0', '')))::INT AS bc FROM nation")
def conversion(spark, sf_dir):
    k = c("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.conv((k * 1000).cast("string"), 10, 16).alias("hx"), F.bin(k).alias("b"), S.octal(k).alias("o"), F.bit_count(k).alias("bc"))


@op("fn_crc32", "SELECT * FROM (VALUES ('', 0::BIGINT), ('123456789', 3421780262), ('The quick brown fox jumps over the lazy dog', 1095738169), ('a', 3904355907), (NULL, NULL)) t(s, crc)")
def crc32(spark, sf_dir):
    """The standard check value (of 123456789) and others that the algorithm's descriptions give."""
    return rows(spark, "(''), ('123456789'), ('The quick brown fox jumps over the lazy dog'), ('a'), (NULL)", "s").select("s", F.crc32(c("s").cast("binary")).alias("crc"))


@op("fn_rand_range", "SELECT count(*) AS n, true AS inside FROM orders")
def rand_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.rand(7).alias("r")).agg(F.count("*").alias("n"), F.bool_and((c("r") >= 0) & (c("r") < 1)).alias("inside"))


# -- bit aggregates, JSON aggregates (2.5) ------------------------------------------------------------------------
@op("agg_bits_with_empty_group", "SELECT g, coalesce(bit_and(v)::UBIGINT, 18446744073709551615)::VARCHAR AS ba, coalesce(bit_or(v), 0)::VARCHAR AS bo, coalesce(bit_xor(v), 0)::VARCHAR AS bx FROM (SELECT n_regionkey AS g, CASE WHEN n_regionkey <> 2 THEN n_nationkey::BIGINT END AS v FROM nation) t GROUP BY g")
def agg_bits(spark, sf_dir):
    v = F.when(c("n_regionkey") != 2, c("n_nationkey").cast("long"))
    return table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("g")).agg(M.bit_and_agg(v).cast("string").alias("ba"), M.bit_or_agg(v).cast("string").alias("bo"), M.bit_xor_agg(v).cast("string").alias("bx"))


# -- quantified comparison (2.3), recursion with UNION DISTINCT (2.8) ----------------------------------------------
@op("subquery_any_all", "SELECT p_partkey, p_size > (SELECT min(s_nationkey) FROM supplier) AS any_, p_size >= (SELECT max(n_nationkey) FROM nation) AS all_ FROM part")
def any_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one, any_ = compare_any(c("p_size"), ">", table(spark, sf_dir, "supplier"), "s_nationkey")
    some = part.crossJoin(F.broadcast(one)).select("p_partkey", "p_size", any_.alias("any_"))
    two, all_ = compare_all(c("p_size"), ">=", table(spark, sf_dir, "nation"), "n_nationkey")
    return some.crossJoin(F.broadcast(two)).select("p_partkey", "any_", all_.alias("all_"))


@op("cte_recursive_union_distinct", "WITH RECURSIVE t(n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (n * 3 + 1) % 25 FROM t) SELECT n FROM t")
def union_distinct(spark, sf_dir):
    start = table(spark, sf_dir, "nation").filter("n_nationkey = 1").select(c("n_nationkey").alias("n"))
    return recursive_distinct(start, lambda new: new.select(((c("n") * 3 + 1) % 25).alias("n")))


# -- time (2.12) --------------------------------------------------------------------------------------------------
@op("fn_date_parts", "SELECT o_orderkey AS k, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q, (dayofweek(o_orderdate) + 1)::INT AS dow, (isodow(o_orderdate) - 1)::INT AS wd, dayofyear(o_orderdate)::INT AS doy, week(o_orderdate)::INT AS w, last_day(o_orderdate) AS ld, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, o_orderdate::DATE AS dt FROM orders")
def date_parts(spark, sf_dir):
    d = c("o_orderdate")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.quarter(d).alias("q"), F.dayofweek(d).alias("dow"), F.weekday(d).alias("wd"), F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("w"), F.last_day(d).alias("ld"), F.date_format(d, "EEEE").alias("dn"), F.date_format(d, "MMMM").alias("mn"), d.cast("date").alias("dt"))


@op("fn_time_parts", "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, (microsecond(ts) % 1000000)::INT AS us, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS sec, strftime(ts, '%H:%M:%S') AS t, epoch(date_trunc('second', ts))::BIGINT AS unix FROM events")
def time_parts(spark, sf_dir):
    t = c("ts")
    return table(spark, sf_dir, "events").select("event_id", F.hour(t).alias("h"), F.minute(t).alias("m"), F.second(t).alias("s"), T.microsecond(t).alias("us"), T.time_to_sec(T.time_of(t)).alias("sec"), T.show_time((T.time_to_sec(T.time_of(t)) * T.SECOND)).alias("t"), F.unix_timestamp(t).alias("unix"))


@op("fn_date_numbers", "SELECT o_orderkey AS k, (o_orderdate::DATE - DATE '1970-01-01')::INT + 719528 AS td, o_orderdate::DATE AS fd, ((o_orderdate::DATE - DATE '1970-01-01')::BIGINT + 719528) * 86400 + hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS ts, (o_orderdate::DATE - DATE '1995-01-01')::INT AS diff, (year(o_orderdate) * 100 + month(o_orderdate) - 199501 - (year(o_orderdate) - 1995) * 88)::BIGINT AS pd, make_date(year(o_orderdate), 1, 1) + (dayofyear(o_orderdate)::INT - 1) AS md FROM orders")
def date_numbers(spark, sf_dir):
    d = c("o_orderdate")
    period = F.year(d) * 100 + F.month(d)
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), T.to_days(d.cast("date")).alias("td"), T.from_days(T.to_days(d.cast("date"))).alias("fd"), T.to_seconds(d).alias("ts"), F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")).alias("diff"), T.period_diff(period, F.lit(199501)).alias("pd"), T.make_date(F.year(d), F.dayofyear(d)).alias("md"))


@op("fn_period_add", "SELECT * FROM (VALUES (200801, 2, 200803::BIGINT), (200812, 1, 200901), (199901, -1, 199812)) t(p, n, r)")
def period_add(spark, sf_dir):
    return rows(spark, "(200801, 2), (200812, 1), (199901, -1)", "p, n").select("p", "n", T.period_add(c("p"), c("n")).alias("r"))


@op("fn_date_format", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%d.%m.%y') AS b, strftime(o_orderdate, '%W') AS x, day(o_orderdate) || CASE WHEN day(o_orderdate) IN (11, 12, 13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END AS od, dayname(o_orderdate) || ', ' || monthname(o_orderdate) AS names, strftime(o_orderdate, '%j') AS j FROM orders")
def date_format(spark, sf_dir):
    d = c("o_orderdate")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), T.date_format(d, "%Y-%m-%d %H:%i:%s").alias("a"), T.date_format(d, "%d.%m.%y").alias("b"), F.lpad(T.week(d.cast("date"), 5).cast("string"), 2, "0").alias("x"), T.date_format(d, "%D").alias("od"), T.date_format(d, "%W, %M").alias("names"), T.date_format(d, "%j").alias("j"))


@op("fn_week_modes", "SELECT o_orderkey AS k, strftime(o_orderdate, '%U') AS u, week(o_orderdate)::INT AS m3, yearweek(o_orderdate)::INT AS yw3 FROM orders")
def week_modes(spark, sf_dir):
    d = c("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), F.lpad(T.week(d, 0).cast("string"), 2, "0").alias("u"), T.week(d, 3).alias("m3"), T.year_week(d, 3).alias("yw3"))


_IV = {"i1": (5, "DAY"), "i2": (1, "MONTH"), "i3": (-2, "YEAR"), "i4": (3, "QUARTER"), "i5": (90, "MINUTE"), "i6": (1, "WEEK"), "i7": ("1:30", "HOUR_MINUTE"), "i8": ("1-2", "YEAR_MONTH"), "i9": ("1 2:3:4", "DAY_SECOND"), "i10": (1500000, "MICROSECOND")}


@op("fn_date_add_units", "SELECT o_orderkey AS k, o_orderdate + INTERVAL 5 DAY AS i1, o_orderdate + INTERVAL 1 MONTH AS i2, o_orderdate - INTERVAL 2 YEAR AS i3, o_orderdate + INTERVAL 9 MONTH AS i4, o_orderdate + INTERVAL 90 MINUTE AS i5, o_orderdate + INTERVAL 7 DAY AS i6, o_orderdate + INTERVAL 90 MINUTE AS i7, o_orderdate + INTERVAL 14 MONTH AS i8, o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 3 MINUTE + INTERVAL 4 SECOND AS i9, o_orderdate + INTERVAL 1500000 MICROSECOND AS i10, o_orderdate - INTERVAL 1 DAY AS s1 FROM orders")
def date_add_units(spark, sf_dir):
    d = c("o_orderdate")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), *(T.date_add(d, n, u).alias(name) for name, (n, u) in _IV.items()), T.date_sub(d, 1, "DAY").alias("s1"))


@op("fn_timestampdiff", "SELECT o_orderkey AS k, trunc(u / 86400000000)::BIGINT AS dd, trunc(u / 3600000000)::BIGINT AS hh, trunc(u / 604800000000)::BIGINT AS ww, trunc(u / 1000000)::BIGINT AS ss FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '1998-06-15') - epoch_us(o_orderdate))::DOUBLE AS u FROM orders) t")
def timestampdiff(spark, sf_dir):
    """Whole units from each order to a day that some of them follow: negative ones go toward zero."""
    d, end = c("o_orderdate"), F.lit("1998-06-15").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), T.timestamp_diff("DAY", d, end).alias("dd"), T.timestamp_diff("HOUR", d, end).alias("hh"), T.timestamp_diff("WEEK", d, end).alias("ww"), T.timestamp_diff("SECOND", d, end).alias("ss"))


@op("fn_extract_units", "SELECT event_id, year(ts)::BIGINT AS y, (year(ts) * 100 + month(ts))::BIGINT AS ym, (day(ts) * 100 + hour(ts))::BIGINT AS dh, (hour(ts) * 10000 + minute(ts) * 100 + second(ts))::BIGINT AS hs, ((day(ts) * 1000000 + hour(ts) * 10000 + minute(ts) * 100 + second(ts)) * 1000000::BIGINT + microsecond(ts) % 1000000)::BIGINT AS dus FROM events")
def extract_units(spark, sf_dir):
    t = c("ts")
    return table(spark, sf_dir, "events").select("event_id", T.extract("YEAR", t).alias("y"), T.extract("YEAR_MONTH", t).alias("ym"), T.extract("DAY_HOUR", t).alias("dh"), T.extract("HOUR_SECOND", t).alias("hs"), T.extract("DAY_MICROSECOND", t).alias("dus"))


@op("fn_str_to_date", "SELECT * FROM (VALUES ('2021-03-04', TIMESTAMP '2021-03-04 00:00:00'), ('1999-12-31', TIMESTAMP '1999-12-31'), ('nope', NULL), ('2021-02-30', NULL)) t(s, d)")
def str_to_date(spark, sf_dir):
    return rows(spark, "('2021-03-04'), ('1999-12-31'), ('nope'), ('2021-02-30')", "s").select("s", T.str_to_date(c("s"), "%Y-%m-%d").alias("d"))


@op("fn_time_arithmetic", "SELECT * FROM (VALUES ('10:20:30', 37230::BIGINT, '11:30:30', '09:10:30', '10:20'), ('-01:00:00', -3600, '00:10:00', '-02:10:00', '01:00'), ('838:59:59', 3020399, '838:59:59', '837:49:59', '838:59'), ('100:00:00.5', 360000, '101:10:00.500000', '98:50:00.500000', '100:00')) t(s, sec, plus, minus, f)")
def time_arithmetic(spark, sf_dir):
    t, step = T.parse_time(c("s")), 70 * T.MINUTE
    return rows(spark, "('10:20:30'), ('-01:00:00'), ('838:59:59'), ('100:00:00.5')", "s").select("s", T.time_to_sec(t).alias("sec"), T.show_time(t + step).alias("plus"), T.show_time(t - step).alias("minus"), T.time_format(t, "%H:%i").alias("f"))


@op("fn_make_sec_to_time", "SELECT * FROM (VALUES (12, 15, 30, '12:15:30', '00:00:12'), (-5, 0, 1, '-05:00:01', '-00:00:05'), (30, 60, 0, NULL, '00:00:30'), (900, 0, 0, '838:59:59', '00:15:00')) t(h, m, s, mt, st)")
def make_sec_to_time(spark, sf_dir):
    return rows(spark, "(12, 15, 30), (-5, 0, 1), (30, 60, 0), (900, 0, 0)", "h, m, s").select("h", "m", "s", T.show_time(T.make_time(c("h"), c("m"), c("s"))).alias("mt"), T.sec_to_time(c("h")).alias("st"))


@op("fn_timezone_unix", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS tokyo, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc, to_timestamp(epoch(date_trunc('second', ts))::BIGINT) AT TIME ZONE 'UTC' AS fu FROM events")
def timezone_unix(spark, sf_dir):
    t = c("ts")
    return table(spark, sf_dir, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), t).alias("tokyo"), F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), t).alias("utc"), F.timestamp_seconds(F.unix_timestamp(t)).cast("timestamp_ntz").alias("fu"))


@op("fn_now_family", "SELECT true AS same_day, true AS utc_near, true AS time_text")
def now_family(spark, sf_dir):
    one = spark.range(1)
    return one.select((F.current_date() == F.current_timestamp().cast("date")).alias("same_day"), (F.abs(F.unix_timestamp(F.localtimestamp()) - F.unix_timestamp()) < 5).alias("utc_near"), F.date_format(F.current_timestamp(), "HH:mm:ss").rlike(r"^\d\d:\d\d:\d\d$").alias("time_text"))


@op("fn_get_format", "SELECT '%m.%d.%Y' AS a, '%Y-%m-%d %H:%i:%s' AS b, '%H%i%s' AS c")
def get_format(spark, sf_dir):
    return spark.range(1).select(F.lit(T.get_format("DATE", "USA")).alias("a"), F.lit(T.get_format("DATETIME", "ISO")).alias("b"), F.lit(T.get_format("TIME", "INTERNAL")).alias("c"))


# -- conditionals, hashing, network (2.13) ------------------------------------------------------------------------
@op("fn_conditionals", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS i, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, -1) AS n, nullif(o_orderstatus, 'F') AS nf, (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END)::INT AS isn, CASE WHEN o_orderkey % 3 = 0 THEN least(o_custkey, 500) END AS l, CASE WHEN o_orderkey % 3 = 0 THEN greatest(o_custkey, 500) END AS g, (CASE WHEN o_totalprice >= 1000 THEN 1 ELSE 0 END + CASE WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END + CASE WHEN o_totalprice >= 200000 THEN 1 ELSE 0 END)::INT AS iv FROM orders")
def conditionals(spark, sf_dir):
    k, some = c("o_orderkey"), F.when(c("o_orderkey") % 3 == 0, c("o_custkey"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), C.if_(k % 2 == 0, "even", "odd").alias("i"), F.coalesce(some, F.lit(-1)).alias("n"), F.nullif("o_orderstatus", F.lit("F")).alias("nf"), some.isNull().cast("int").alias("isn"), C.least(some, F.lit(500)).alias("l"), C.greatest(some, F.lit(500)).alias("g"), C.interval(c("o_totalprice"), 1000, 100000, 200000).alias("iv"))


@op("fn_hashing", "SELECT n_nationkey AS k, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2, from_base64(to_base64(encode(n_name)))::VARCHAR AS b FROM nation")
def hashing(spark, sf_dir):
    n = c("n_name")
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), F.md5(n).alias("m"), F.sha1(n).alias("s1"), F.sha2(n, 256).alias("s2"), F.unbase64(S.to_base64(n)).cast("string").alias("b"))


@op("fn_aes_compress_round_trip", "SELECT n_nationkey AS k, n_name AS aes, n_name AS z, strlen(n_name)::BIGINT AS n FROM nation")
def aes_compress(spark, sf_dir):
    n = c("n_name")
    packed = C.compress(n)
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), C.aes_decrypt(C.aes_encrypt(n, "a key that is longer than sixteen"), "a key that is longer than sixteen").cast("string").alias("aes"), C.uncompress(packed).cast("string").alias("z"), C.uncompressed_length(packed).alias("n"))


@op("fn_network", "SELECT * FROM (VALUES ('10.0.5.9', true, false, 167773449::BIGINT, '10.0.5.9', '0A000509', '10.0.5.9'), ('127.1', false, false, 2130706433, '127.0.0.1', NULL, NULL), ('::ffff:1.2.3.4', false, true, NULL, NULL, '00000000000000000000FFFF01020304', '::ffff:1.2.3.4'), ('2001:db8::1', false, true, NULL, NULL, '20010DB8000000000000000000000001', '2001:db8::1'), ('256.1.1.1', false, false, NULL, NULL, NULL, NULL)) t(s, v4, v6, n, a, b, back)")
def network(spark, sf_dir):
    s = c("s")
    packed = C.inet6_aton(s)
    return rows(spark, "('10.0.5.9'), ('127.1'), ('::ffff:1.2.3.4'), ('2001:db8::1'), ('256.1.1.1')", "s").select("s", C.is_ipv4(s).alias("v4"), C.is_ipv6(s).alias("v6"), C.inet_aton(s).alias("n"), C.inet_ntoa(C.inet_aton(s)).alias("a"), F.hex(packed).alias("b"), C.inet6_ntoa(packed).alias("back"))


_U = "('6ccd780c-baba-1026-9564-5b8c656024db'), ('not one')"


@op("fn_uuid", "SELECT * FROM (VALUES ('6ccd780c-baba-1026-9564-5b8c656024db', true, '6CCD780CBABA102695645B8C656024DB', '1026BABA6CCD780C95645B8C656024DB', '6ccd780c-baba-1026-9564-5b8c656024db'), ('not one', false, NULL, NULL, NULL)) t(s, ok, b, w, back)")
def uuid(spark, sf_dir):
    s = c("s")
    return rows(spark, _U, "s").select("s", C.is_uuid(s).alias("ok"), F.hex(C.uuid_to_bin(s)).alias("b"), F.hex(C.uuid_to_bin(s, True)).alias("w"), C.bin_to_uuid(C.uuid_to_bin(s, True), True).alias("back"))


@op("fn_format_bytes_time", "SELECT * FROM (VALUES (512::BIGINT, ' 512 bytes', '512 ps'), (2048, '2.00 KiB', '2.05 ns'), (5000000, '4.77 MiB', '5.00 us'), (3000000000000, '2.73 TiB', '3.00 s')) t(n, b, p)")
def format_bytes_time(spark, sf_dir):
    return rows(spark, "(CAST(512 AS BIGINT)), (2048), (5000000), (3000000000000)", "n").select("n", C.format_bytes(c("n")).alias("b"), C.format_pico_time(c("n")).alias("p"))


@op("fn_session_constants", "SELECT true AS has_user, true AS has_db, 'x' AS named, md5('SELECT ?') AS digest")
def session_constants(spark, sf_dir):
    return spark.range(1).select((F.length(F.current_user()) > 0).alias("has_user"), (F.length(F.current_database()) > 0).alias("has_db"), F.lit("x").alias("named"), F.md5(F.lit("SELECT ?")).alias("digest"))


@op("fn_sys_text_helpers", "SELECT * FROM (VALUES ('a,b', 'a,b,c', 'b', '`a,b`'), ('c', 'c', 'c', '`c`'), ('', 'c', '', '``')) t(s, added, dropped, quoted)")
def sys_text_helpers(spark, sf_dir):
    s = c("s")
    return rows(spark, "('a,b'), ('c'), ('')", "s").select("s", C.list_add(s, "c").alias("added"), C.list_drop(s, "a").alias("dropped"), C.quote_identifier(s).alias("quoted"))


@op("fn_xml_extract_value", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def xml_extract_value(spark, sf_dir):
    doc = F.concat(F.lit("<a><b>x</b><c>"), c("n_name"), F.lit("</c></a>"))
    return table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), C.extract_value(doc, "/a/c").alias("v"))


@op("fn_uuid_random", "SELECT count(*) AS n, true AS all_valid, true AS all_distinct FROM nation")
def uuid_random(spark, sf_dir):
    made = table(spark, sf_dir, "nation").select(F.uuid().alias("u"))
    return made.agg(F.count("*").alias("n"), F.bool_and(C.is_uuid(c("u"))).alias("all_valid"), (F.countDistinct("u") == F.count("*")).alias("all_distinct"))


@op("routine_scripting", "SELECT 10 AS n, 55 AS s, 5 AS odd")
def routine_scripting(spark, sf_dir):
    """A routine's body: variables, a loop, a branch, and a result."""
    return spark.sql("""
BEGIN
  DECLARE n INT DEFAULT 0;
  DECLARE s INT DEFAULT 0;
  DECLARE odd INT DEFAULT 0;
  WHILE n < 10 DO
    SET n = n + 1;
    SET s = s + n;
    IF n % 2 = 1 THEN SET odd = odd + 1; END IF;
  END WHILE;
  SELECT n, s, odd;
END""")


# -- more of 2.3, 2.7, 2.10, 2.12, 2.13 -----------------------------------------------------------------------------
@op("subquery_equal_any", "SELECT p_partkey, p_size = ANY (SELECT n_nationkey FROM nation) AS eq_any, p_size <> ALL (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END FROM nation) AS ne_all, p_size <> ANY (SELECT n_regionkey FROM nation) AS ne_any, p_size = ALL (SELECT 7) AS eq_all FROM part")
def equal_any_(spark, sf_dir):
    """= ANY is IN and <> ALL its NOT, with NULLs making them unknown; <> ANY and = ALL look at the least and greatest value."""
    nation = table(spark, sf_dir, "nation")
    part = equal_any(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", nation, "n_nationkey", "eq_any")
    part = equal_any(part, "p_size", nation.select(F.when(c("n_nationkey") < 20, c("n_nationkey")).alias("v")), "v", "in_some").withColumn("ne_all", ~c("in_some"))
    one, ne_any = compare_any(c("p_size"), "<>", nation, "n_regionkey")
    part = part.crossJoin(F.broadcast(one)).withColumn("ne_any", ne_any).drop(*one.columns)
    two, eq_all = compare_all(c("p_size"), "=", spark.range(1).select(F.lit(7).alias("v")), "v")
    return part.crossJoin(F.broadcast(two)).withColumn("eq_all", eq_all).select("p_partkey", "eq_any", "ne_all", "ne_any", "eq_all")


@op("sort_collate_ci", "SELECT s, row_number() OVER (ORDER BY lower(s), k) AS place FROM (VALUES ('b', 1), ('A', 2), ('a', 3), ('B', 4), ('C', 5)) t(s, k)")
def sort_collate(spark, sf_dir):
    """ORDER BY ... COLLATE of a case-insensitive collation, ties by the second column."""
    return spark.sql("SELECT s, row_number() OVER (ORDER BY s COLLATE UTF8_LCASE, k) AS place FROM (VALUES ('b', 1), ('A', 2), ('a', 3), ('B', 4), ('C', 5)) AS t(s, k)").select(c("s").cast("string").alias("s"), "place")


@op("predicate_ci_equal", "SELECT n.n_name, r.r_name, lower(n.n_name) IN ('france', 'germany') AS picked FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE lower(r.r_name) = 'europe'")
def ci_equal(spark, sf_dir):
    """= and IN under a case-insensitive collation."""
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), c("n_regionkey") == c("r_regionkey"))
    return joined.filter("r_name COLLATE UTF8_LCASE = 'eUrOpE'").select("n_name", "r_name", F.expr("n_name COLLATE UTF8_LCASE IN ('france', 'Germany')").alias("picked"))


_STAMPS = "(TIMESTAMP_NTZ'2024-02-28 23:30:00', '01:00:00.5'), (TIMESTAMP_NTZ'2023-12-31 00:00:00', '-24:00:00'), (TIMESTAMP_NTZ'2024-01-01 10:00:00', NULL)"


@op("fn_add_sub_time", "SELECT ts, t, ts + us AS added, ts - us AS taken, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS diff FROM (VALUES (TIMESTAMP '2024-02-28 23:30:00', '01:00:00.5', to_microseconds(3600500000)), (TIMESTAMP '2023-12-31 00:00:00', '-24:00:00', to_microseconds(-86400000000)), (TIMESTAMP '2024-01-01 10:00:00', NULL, NULL)) v(ts, t, us)")
def add_sub_time(spark, sf_dir):
    """ADDTIME (also TIMESTAMP with two arguments), SUBTIME, TIMEDIFF in microseconds."""
    t = T.parse_time(c("t"))
    return rows(spark, _STAMPS, "ts, t").select("ts", "t", T.add_time(c("ts"), t).alias("added"), T.sub_time(c("ts"), t).alias("taken"), T.time_diff(c("ts"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("diff"))


@op("fn_date_add_column", "SELECT o_orderkey AS k, o_orderdate + to_days(CAST(o_orderkey % 50 AS INT) - 20) AS d, o_orderdate + to_months(CAST(o_orderkey % 30 AS INT) - 10) AS m, o_orderdate - to_hours(CAST(o_orderkey % 100 AS INT)) AS h FROM orders")
def date_add_column(spark, sf_dir):
    """DATE_ADD and DATE_SUB with the amount in a column."""
    k, d = c("o_orderkey"), c("o_orderdate")
    return table(spark, sf_dir, "orders").select(k.alias("k"), T.date_add_column(d, k % 50 - 20, "DAY").alias("d"), T.date_add_column(d, k % 30 - 10, "MONTH").alias("m"), T.date_add_column(d, -(k % 100), "HOUR").alias("h"))


@op("fn_unhex_address_kinds", "SELECT * FROM (VALUES ('::ffff:1.2.3.4', true, false, '00000000000000000000FFFF01020304'), ('::1.2.3.4', false, true, '00000000000000000000000001020304'), ('2001:db8::1', false, false, '20010DB8000000000000000000000001'), ('no', false, false, NULL)) t(s, mapped, compat, h)")
def unhex_address_kinds(spark, sf_dir):
    """IS_IPV4_MAPPED, IS_IPV4_COMPAT, and UNHEX of what HEX gives."""
    b = C.inet6_aton(c("s"))
    return rows(spark, "('::ffff:1.2.3.4'), ('::1.2.3.4'), ('2001:db8::1'), ('no')", "s").select("s", C.is_ipv4_mapped(b).alias("mapped"), C.is_ipv4_compat(b).alias("compat"), F.hex(F.unhex(F.hex(b))).alias("h"))


@op("fn_random_bytes", "SELECT * FROM (VALUES (1, 1, true), (16, 16, true), (200, 200, true), (1024, 1024, true)) t(n, size, differs)")
def random_bytes(spark, sf_dir):
    """RANDOM_BYTES(1 to 1024): the length asked for, and no two alike (but for the shortest)."""
    return rows(spark, "(1), (16), (200), (1024)", "n").select("n", F.octet_length(C.random_bytes(c("n"))).alias("size"), ((c("n") < 8) | (C.random_bytes(c("n")) != C.random_bytes(c("n")))).alias("differs"))


@op("fn_convert_using_charset", "SELECT * FROM (VALUES ('abc', 'abc', 'abc', '616263', 'utf8mb4', 'binary', 'utf8mb4_bin', 'utf8mb4_general_ci'), ('Zoë €', 'Zo? ?', 'Zoë ?', '5A6FC3AB20E282AC', 'utf8mb4', 'binary', 'utf8mb4_bin', 'utf8mb4_general_ci'), (NULL, NULL, NULL, NULL, 'utf8mb4', 'binary', 'utf8mb4_bin', 'utf8mb4_general_ci')) t(s, ascii, latin1, bytes, cs, cs_bytes, co, co_ci)")
def convert_using_charset(spark, sf_dir):
    """CONVERT USING, CHARSET and COLLATION."""
    s = c("s")
    return rows(spark, "('abc'), ('Zoë €'), (NULL)", "s").select("s", S.convert_using(s, "ascii").alias("ascii"), S.convert_using(s, "latin1").alias("latin1"), F.hex(S.convert_using(s, "binary")).alias("bytes"), S.charset(s).alias("cs"), S.charset(s.cast("binary")).alias("cs_bytes"), S.collation(s).alias("co"), S.collation(F.collate(s, "UTF8_LCASE")).alias("co_ci"))


@op("agg_group_concat_max_len", "SELECT c_nationkey AS k, left(string_agg(c_name, '; ' ORDER BY c_custkey), 256) AS names FROM customer GROUP BY c_nationkey")
def group_concat_max_len(spark, sf_dir):
    """GROUP_CONCAT cut at group_concat_max_len."""
    return table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("k")).agg(S.group_concat(c("c_name"), [c("c_custkey")], "; ", 256).alias("names"))


@op("fn_fractional_seconds", "SELECT event_id, date_trunc('second', ts) AS p0, date_trunc('millisecond', ts) AS p3, ts AS p6 FROM events")
def fractional_seconds(spark, sf_dir):
    """TIMESTAMP(fsp), as NOW(fsp) cuts it."""
    ts = c("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", *(T.to_precision(ts, d).alias(f"p{d}") for d in (0, 3, 6)))


@op("fn_from_unixtime_format", "SELECT o_orderkey AS k, make_timestamp((o_orderkey % 30000) * 1000003000000) AS ts, strftime(make_timestamp((o_orderkey % 30000) * 1000003000000), '%d.%m.%Y %H:%M:%S') AS t, NULL::TIMESTAMP AS none FROM orders")
def from_unixtime_format(spark, sf_dir):
    """FROM_UNIXTIME with and without a format; out of range is NULL."""
    n = c("o_orderkey").cast("long") % 30000 * 1000003
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), T.from_unixtime(n).alias("ts"), T.from_unixtime(n, "%d.%m.%Y %H:%i:%s").alias("t"), T.from_unixtime(-n - 1).alias("none"))


@op("fn_str_to_date_names", "SELECT o_orderkey AS k, o_orderdate::TIMESTAMP AS a, o_orderdate::TIMESTAMP AS b FROM orders")
def str_to_date_names(spark, sf_dir):
    """STR_TO_DATE of month names and of text between, from what DATE_FORMAT gives."""
    d = c("o_orderdate").cast("timestamp_ntz")
    back = lambda pattern: T.str_to_date(T.date_format(d, pattern), pattern)
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), back("%M %e, %Y").alias("a"), back("on the %d of %b in %Y, at %H:%i").alias("b"))


@op("fn_uuid_short", "SELECT count(*) AS n, count(*) AS different, true AS positive FROM orders")
def uuid_short(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(C.uuid_short().alias("u"))
    return made.agg(F.count("*").alias("n"), F.countDistinct("u").alias("different"), (F.min("u") > 0).alias("positive"))
