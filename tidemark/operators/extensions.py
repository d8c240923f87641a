"""Dialect queries, SQL functions, parameters, and extensions: streaming, as-of and range joins, approximate aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.dialect import translate
from tidemark.plans.rewrites import medians, tasks
from tidemark.plans.routines import Routines
from tidemark.plans.views import run_sql
from tidemark.registry import op
from tidemark.session import table
from tidemark.streaming import events as S

c = F.col


def mysql(name: str, text: str, oracle: str, /, **variables) -> None:
    op(name, oracle)(lambda spark, sf_dir: run_sql(spark, sf_dir, translate(text, variables)))


mysql("dialect_limit_offset_comma", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
mysql("dialect_operators", 'SELECT `n_nationkey` AS k, (n_regionkey > 1) XOR (n_nationkey > 5) AS x, n_regionkey = 1 && n_nationkey > 2 AS a, n_regionkey = 1 || n_nationkey > 20 AS o, n_name LIKE "a%" AS l, n_name REGEXP "^[a-c]" AS r FROM nation # a comment', "SELECT n_nationkey AS k, (n_regionkey > 1) <> (n_nationkey > 5) AS x, n_regionkey = 1 AND n_nationkey > 2 AS a, n_regionkey = 1 OR n_nationkey > 20 AS o, n_name ILIKE 'a%' AS l, regexp_matches(n_name, '(?i)^[a-c]') AS r FROM nation")
mysql("dialect_functions", "SELECT n_nationkey AS k, IF(n_regionkey, 'yes', 'no') AS i, ISNULL(n_name) AS isn, MOD(n_nationkey, n_regionkey) AS m, LENGTH(n_name) AS n, IFNULL(NULLIF(n_regionkey, 2), -1) AS f, CONVERT(n_nationkey, CHAR) AS s, CAST(n_nationkey AS SIGNED) AS b, LEAST(n_nationkey, NULL) AS le FROM nation", "SELECT n_nationkey AS k, CASE WHEN n_regionkey <> 0 THEN 'yes' ELSE 'no' END AS i, 0 AS isn, CASE WHEN n_regionkey <> 0 THEN n_nationkey % n_regionkey END AS m, strlen(n_name)::INT AS n, coalesce(nullif(n_regionkey, 2), -1) AS f, n_nationkey::VARCHAR AS s, n_nationkey::BIGINT AS b, NULL::INT AS le FROM nation")
mysql("dialect_group_concat", "SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name DESC SEPARATOR '; ') AS g, STD(n_nationkey) > 0 AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name DESC) AS g, stddev_pop(n_nationkey) > 0 AS s FROM nation GROUP BY n_regionkey")
mysql("dialect_having_alias", "SELECT n_nationkey * 2 AS twice, n_name FROM nation HAVING twice > 10 ORDER BY twice LIMIT 7", "SELECT n_nationkey * 2 AS twice, n_name FROM nation WHERE n_nationkey * 2 > 10 ORDER BY 1 LIMIT 7")
mysql("dialect_straight_join_dual", "SELECT n_name, r_name, one FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey JOIN (SELECT 1 AS one FROM DUAL) d FOR UPDATE", "SELECT n_name, r_name, 1 AS one FROM nation JOIN region ON n_regionkey = r_regionkey")
mysql("dialect_user_variables", "SELECT n_nationkey FROM nation WHERE n_regionkey = @region AND n_name <> @name", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_name <> 'it''s'", region=2, name="it's")


mysql("dialect_literals", "SELECT n_nationkey AS k, b'101' + 0b11 AS bits, CONVERT(CONCAT(n_name, 'ë') USING ascii) AS a, TIMESTAMP '2024-01-02 03:04:05' AS ts, DATE '2024-02-29' AS d, HEX(0x4D2) AS h, 1.50 AS dec FROM nation", "SELECT n_nationkey AS k, 8 AS bits, n_name || '?' AS a, TIMESTAMP '2024-01-02 03:04:05' AS ts, DATE '2024-02-29' AS d, '04D2' AS h, 1.50 AS dec FROM nation")


@op("procedure_call", "SELECT 55 AS total, 12 AS level")
def procedure_call(spark, sf_dir):
    """CREATE PROCEDURE with IN, OUT and INOUT parameters, and CALL."""
    routines = Routines(spark)
    routines.create("add_up", "IN n INT, OUT total INT, INOUT level INT", "DECLARE i INT DEFAULT 0; SET total = 0; WHILE i < n DO SET i = i + 1; SET total = total + i; END WHILE; IF total > 50 THEN SET level = level + n; END IF;")
    return routines.call("add_up", 10, None, 2)


@op("prepared_statement_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def prepared(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", least=100000, status="O")


@op("sql_function_expression", "SELECT o_orderkey, round(o_totalprice * 1.1 + 5, 4) AS gross FROM orders")
def sql_function(spark, sf_dir):
    """CREATE FUNCTION with an expression body is inlined by Catalyst."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_gross(x DOUBLE, fee DOUBLE) RETURNS DOUBLE RETURN x * 1.1 + fee")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.expr("tidemark_gross(o_totalprice, 5D)"), 4).alias("gross"))


@op("ci_collation_group", "SELECT lower(k) AS k, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS k FROM part) t GROUP BY lower(k)")
def ci_group(spark, sf_dir):
    """Grouping under a case-insensitive collation."""
    mixed = F.when(c("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    return table(spark, sf_dir, "part").select(F.collate(mixed, "UTF8_LCASE").alias("g")).groupBy("g").agg(F.count("*").alias("n")).select(F.lower(F.collate("g", "UTF8_BINARY")).alias("k"), "n")


@op("ext_stream_tumbling_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    """A streaming hourly aggregate, run over the events that there are."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", c("ts").cast("timestamp"))
    found = S.run_to_end(S.windowed(events), _root(spark), "complete")
    return found.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _root(spark) -> str | None:
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base}/streams" if base else None


@op("ext_session_window", "WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) x) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g")
def session_window(spark, sf_dir):
    """Sessions by gaps of at most 30 minutes (session_window would part at a gap of exactly that length)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(c("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").withColumn("fresh", F.when(micros - F.lag(micros).over(w) <= 1800 * 10**6, 0).otherwise(1))
    return events.withColumn("g", F.sum("fresh").over(w)).groupBy("user_id", "g").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("g")


@op("ext_asof_join", "SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof(spark, sf_dir):
    """As-of join: both sides in one stream by key and time, the last seen row of the right side carried on."""
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lit(1).alias("side"))
    right = events.filter("event_type = 'view'").select("user_id", "ts", "event_id", F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("ts", "side", F.when(c("side") == 0, c("event_id"))).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(c("side") == 0, c("event_id")), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("before", seen).filter("side = 1").select("event_id", "before")


@op("ext_range_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def range_join(spark, sf_dir):
    """Range join: time in bins of the range's length, so that an equi-join on user and bin finds all candidates."""
    bin_ = F.floor(F.unix_micros(c("ts").cast("timestamp")) / (3600 * 10**6))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", bin_.alias("bin"))
    left = events.select(c("event_id").alias("a"), "user_id", c("ts").alias("ats"), F.explode(F.array("bin", c("bin") + 1)).alias("bin"))
    right = events.select(c("event_id").alias("b"), "user_id", c("ts").alias("bts"), "bin")
    return left.join(right, ["user_id", "bin"]).filter("bts > ats AND bts <= ats + INTERVAL 1 HOUR").select("a", "b")


@op("ext_approximate_aggregates", "SELECT l_returnflag, true AS near_distinct, true AS near_median FROM lineitem GROUP BY l_returnflag")
def approximate(spark, sf_dir):
    """approx_count_distinct and percentile_approx against the exact values, within their stated errors.

    Each exact value has a plan of its own: beside a distinct count, Spark keeps the other aggregates' buffers for each
    pair of flag and order. The estimate of a distinct count is the same over the different pairs.
    """
    rows = table(spark, sf_dir, "lineitem")
    pairs = rows.select("l_returnflag", "l_orderkey").repartition(tasks(rows), "l_returnflag", "l_orderkey").distinct()
    counts = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("d"), F.count("l_orderkey").alias("e"))
    middle = medians(rows, "l_returnflag", "l_extendedprice", "m", "x").withColumnRenamed("l_returnflag", "flag")
    g = counts.join(middle, c("l_returnflag").eqNullSafe(c("flag")), "left")  # a flag without any price has no middle
    near = c("m").eqNullSafe(c("x")) | (F.abs(c("m") - c("x")) <= 0.05 * F.abs("x"))
    return g.select("l_returnflag", (F.abs(c("d") - c("e")) <= 0.1 * c("e")).alias("near_distinct"), near.alias("near_median"))


@op("ext_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
