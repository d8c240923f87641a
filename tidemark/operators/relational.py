"""Relational queries: scans, projections, predicates, joins, sub-queries, grouping, windows, sorting, sets, CTEs.

Each is one statement that Spark plans from the Parquet scans, beside the DuckDB statement with the same meaning; only
a row number over a whole table is a plan of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.changes import scratch
from tidemark.plans.rewrites import tasks
from tidemark.plans.views import run_sql
from tidemark.registry import op
from tidemark.session import table
from tidemark.store.engine import numbered


def sql(name: str, spark_text: str, duck_text: str | None = None) -> None:
    """Register a statement; the second text only where the dialects differ."""
    op(name, spark_text if duck_text is None else duck_text)(lambda spark, sf_dir, text=spark_text: run_sql(spark, sf_dir, text))


# -- scans (2.1), projection, filter, predicates (2.3) ------------------------------------------------------------
sql("scan_base_table", "SELECT * FROM customer")
sql("scan_dual", "SELECT 1 AS one, 'x' AS s, CAST(NULL AS INT) AS n")
sql("scan_derived_table", "SELECT t.k, t.total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) FROM orders GROUP BY o_custkey) AS t(k, total) WHERE t.total > 100000")
sql("scan_values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
sql("project_star_alias", "SELECT n.*, upper(n_name) AS upper_name, n_regionkey + 1 AS next_region FROM nation n")
sql("filter_comparisons", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11' AND p_retailprice > 1000")
sql("filter_pushdown_date", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ'1996-01-01' AND l_shipdate < TIMESTAMP_NTZ'1996-04-01'", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01'")
sql("predicate_null_safe_equal", "SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (NULL), (2)) a(x) JOIN (VALUES (1), (NULL), (3)) b(x) ON a.x <=> b.x", "SELECT a.x AS ax, b.x AS bx FROM (VALUES (1), (NULL), (2)) a(x) JOIN (VALUES (1), (NULL), (3)) b(x) ON a.x IS NOT DISTINCT FROM b.x")
_V = "(VALUES (true), (false), (CAST(NULL AS BOOLEAN)))"
sql("predicate_three_valued_logic", f"SELECT a.x AS ax, b.x AS bx, a.x AND b.x AS conj, a.x OR b.x AS disj, a.x <> b.x AS xor_, NOT a.x AS neg FROM {_V} a(x) CROSS JOIN {_V} b(x)")
sql("predicate_is_tests", f"SELECT x, x IS NULL AS is_null, x IS NOT NULL AS not_null, x IS TRUE AS is_true, x IS NOT TRUE AS not_true, x IS FALSE AS is_false, x IS UNKNOWN AS is_unknown FROM {_V} a(x)", f"SELECT x, x IS NULL AS is_null, x IS NOT NULL AS not_null, x IS NOT DISTINCT FROM true AS is_true, x IS DISTINCT FROM true AS not_true, x IS NOT DISTINCT FROM false AS is_false, x IS NULL AS is_unknown FROM {_V} a(x)")
sql("predicate_between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT BETWEEN 10 AND 20 AND o_orderstatus NOT IN ('P')")
sql("predicate_row_constructors", "SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) = ('N', 'O') AS is_open FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('N', 'O'), ('A', 'F')) AND l_linenumber = 1")
sql("predicate_like_ci", "SELECT p_partkey, p_name ILIKE '%A%' AS has_a, p_type LIKE '%_D%' AS like_bin, p_name ILIKE 'b_%' AS second FROM part")
sql("predicate_like_escape", r"SELECT s, s LIKE '50!%%' ESCAPE '!' AS pct, s LIKE 'a!_b' ESCAPE '!' AS under FROM (VALUES ('50% off'), ('500'), ('a_b'), ('axb')) AS t(s)")
sql("predicate_regexp_ci", "SELECT c_custkey, c_name RLIKE '(?i)CUSTOMER.*[02468]$' AS hit FROM customer", "SELECT c_custkey, regexp_matches(c_name, '(?i)CUSTOMER.*[02468]$') AS hit FROM customer")
sql("predicate_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
sql("subquery_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
sql("subquery_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql("subquery_scalar_correlated", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("subquery_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("subquery_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey < 4 THEN r_regionkey END FROM region)")
sql("subquery_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
sql("having_without_group_by", "SELECT * FROM (SELECT n_nationkey AS k, n_nationkey * 2 AS twice FROM nation) t WHERE twice > 20")

# -- joins (2.4) --------------------------------------------------------------------------------------------------
sql("join_inner_equi", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
sql("join_inner_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) big RIGHT JOIN customer ON c_custkey = o_custkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_using", "SELECT k, a.v AS av, b.v AS bv FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a JOIN (SELECT s_nationkey AS k, s_name AS v FROM supplier) b USING (k)")
sql("join_natural", "SELECT k, av, bv FROM (SELECT n_nationkey AS k, n_name AS av FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS bv FROM supplier) b")
sql("join_natural_left", "SELECT k, av, bv FROM (SELECT n_nationkey AS k, n_name AS av FROM nation) a NATURAL LEFT JOIN (SELECT s_suppkey AS k, s_name AS bv FROM supplier WHERE s_suppkey < 10) b")
sql("join_straight", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey")
sql("join_comma_equi", "SELECT n_name, r_name, s_name FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND r_name <> 'ASIA'")
sql("join_comma_nonequi", "SELECT r.r_regionkey AS r, n.n_nationkey AS n FROM region r, nation n WHERE r.r_regionkey > n.n_nationkey")
sql("join_count_product", "SELECT count(*) AS n FROM region, nation, region r2")
sql("join_semi", "SELECT p_partkey FROM part LEFT SEMI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) l ON p_partkey = l_partkey", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
sql("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
sql("join_star_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")

# -- grouping and aggregation (2.5) -------------------------------------------------------------------------------
sql("group_by_columns", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("group_by_expression_ordinal_alias", "SELECT year(o_orderdate) AS y, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, st")
sql("group_global_aggregate_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0")
sql("group_rollup_grouping", "SELECT l_returnflag AS f, l_linestatus AS s, grouping(l_returnflag) AS gf, grouping(l_linestatus) AS gs, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING n > 12 AND sum(o_totalprice) > 500000", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 500000")
sql("group_functional_dependency", "SELECT n_nationkey, any_value(n_name) AS n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
sql("select_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
sql("agg_counts", "SELECT o_orderstatus AS st, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS big, count(DISTINCT o_custkey) AS cust, count(DISTINCT o_custkey, o_orderpriority) AS pairs FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus AS st, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS big, count(DISTINCT o_custkey) AS cust, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs FROM orders GROUP BY o_orderstatus")
sql("agg_sum_avg", "SELECT p_brand, sum(p_size) AS s, sum(DISTINCT p_size) AS sd, round(avg(p_size), 6) AS a, round(avg(DISTINCT p_size), 6) AS ad, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS exact FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s, CAST(sum(DISTINCT p_size) AS BIGINT) AS sd, round(avg(p_size), 6) AS a, round(avg(DISTINCT p_size), 6) AS ad, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS exact FROM part GROUP BY p_brand")
sql("agg_min_max", "SELECT l_returnflag, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
sql("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names, listagg(DISTINCT left(n_name, 1), '') WITHIN GROUP (ORDER BY left(n_name, 1)) AS initials FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 1), '' ORDER BY left(n_name, 1)) AS initials FROM nation GROUP BY n_regionkey")
sql("agg_variance", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY l_returnflag")
sql("agg_inside_expression", "SELECT o_orderpriority AS p, round(sum(o_totalprice) / count(*) + max(o_orderkey), 4) AS x, count(*) > 3000 AS many FROM orders GROUP BY o_orderpriority")
sql("agg_window_over_aggregate", "SELECT o_orderstatus AS st, round(sum(o_totalprice), 2) AS s, round(sum(sum(o_totalprice)) OVER (), 2) AS total, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_orderstatus")

# -- windows (2.6) ------------------------------------------------------------------------------------------------
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("window_ranking", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(cume_dist() OVER w, 9) AS cd, round(percent_rank() OVER w, 9) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
sql("window_ntile", f"SELECT o_orderkey, ntile(4) OVER ({_W}) AS q, ntile(3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS t FROM orders")
sql("window_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER w AS l1, lag(o_orderkey, 2, -1) OVER w AS l2, lead(o_orderkey) OVER w AS d1, lead(o_orderkey, 3, 0) OVER w AS d3 FROM orders WINDOW w AS ({_W})")
sql("window_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lf FROM orders WINDOW w AS ({_W})")
sql("window_aggregates", f"SELECT o_orderkey, count(*) OVER w AS n, count(o_orderstatus) OVER w AS c, sum(o_orderkey) OVER w AS s, round(avg(o_orderkey) OVER w, 6) AS a, min(o_orderkey) OVER w AS lo, max(o_orderkey) OVER w AS hi FROM orders WINDOW w AS ({_W})", f"SELECT o_orderkey, count(*) OVER w AS n, count(o_orderstatus) OVER w AS c, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, round(avg(o_orderkey) OVER w, 6) AS a, min(o_orderkey) OVER w AS lo, max(o_orderkey) OVER w AS hi FROM orders WINDOW w AS ({_W})")
sql("window_variance", "SELECT o_orderkey, round(var_pop(o_orderkey) OVER w, 2) AS vp, round(var_samp(o_orderkey) OVER w, 2) AS vs, round(stddev_pop(o_orderkey) OVER w, 4) AS sp, round(stddev_samp(o_orderkey) OVER w, 4) AS ss FROM orders WINDOW w AS (PARTITION BY o_custkey)")
sql("window_bits", "SELECT o_orderkey, bit_and(o_orderkey) OVER w AS ba, bit_or(o_orderkey) OVER w AS bo, bit_xor(o_orderkey) OVER w AS bx FROM orders WINDOW w AS (PARTITION BY o_custkey)")
sql("window_rows_frame", f"SELECT o_orderkey, sum(o_orderkey) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM orders", f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM orders")
sql("window_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS peers FROM orders")
sql("window_default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS with_peers, count(*) OVER (PARTITION BY o_custkey) AS whole FROM orders")
sql("window_in_expression", f"SELECT o_orderkey, o_orderkey - lag(o_orderkey, 1, o_orderkey) OVER ({_W}) AS gap, CASE WHEN row_number() OVER ({_W}) = 1 THEN 'first' ELSE 'later' END AS kind FROM orders")

# -- sort, limit (2.7) --------------------------------------------------------------------------------------------
@op("sort_multi_key_null_order", "SELECT o_orderkey, row_number() OVER (ORDER BY b DESC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS b FROM orders) t")
def sort_multi_key(spark, sf_dir):
    """A row number over the whole table: ranges of the order are sorted each by a task and numbered from their sizes."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    order = (F.when(key % 7 != 0, F.col("o_orderpriority")).desc_nulls_last(), key.asc_nulls_last())
    rows = orders.repartitionByRange(tasks(orders), *order).sortWithinPartitions(*order).select(key)

    def stage(df):
        place = scratch(spark)
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    return numbered(rows, "place", stage).select(key, (F.col("place") + 1).cast("int").alias("place"))


sql("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql("sort_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
sql("sort_hidden_column", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
sql("sort_ordinal_alias", "SELECT p_size AS s, count(*) AS n FROM part GROUP BY p_size ORDER BY 2 DESC, s LIMIT 5")

# -- set operations, CTEs (2.8) -----------------------------------------------------------------------------------
sql("set_union_all", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
sql("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("set_union_order_limit", "SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region ORDER BY v DESC LIMIT 4")
sql("set_union_nested", "(SELECT 1 AS x UNION ALL SELECT 1) UNION (SELECT 2 AS x UNION ALL SELECT 2)")
sql("ext_set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("ext_set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20")
sql("cte_plain", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY o_custkey), top(k, n) AS (SELECT o_custkey, n FROM big WHERE n > 5) SELECT c_name, n FROM top JOIN customer ON c_custkey = k")
sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("cte_recursive_deep", "WITH RECURSIVE t(n) MAX RECURSION LEVEL 1000 AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 400) SELECT count(*) AS n, sum(n) AS s FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 400) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS s FROM t")

# -- extensions (2.19) --------------------------------------------------------------------------------------------
sql("ext_full_outer_join", "SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
sql("ext_cube", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("ext_grouping_sets", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
# The rank is written out: of LATERAL (... ORDER BY a column that isn't selected LIMIT 1) Spark 4.1 plans a row_number without the order.
# The SQL's customers are those of orders, with or without a row in customer.
sql("ext_lateral", "SELECT c_custkey, t.o_orderkey FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) c, LATERAL (SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM orders) r WHERE o_custkey <=> c_custkey AND place = 1) t", "SELECT o_custkey AS c_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
