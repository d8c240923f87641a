"""Queries over the versioned store and delimited text: each works on a scratch copy and returns the table's rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tidemark.registry import op
from tidemark.session import table
from tidemark.sources.delimited import into_outfile, load_data
from tidemark.store import Column, Engine, ForeignKey, TableDef

c = F.col
NATION = TableDef((Column("n_nationkey", "int", False), Column("n_name", "string"), Column("n_regionkey", "int")), ("n_nationkey",))
REGION = TableDef((Column("r_regionkey", "int", False), Column("r_name", "string")), ("r_regionkey",))


def scratch(spark) -> str:
    """A folder below the shared one that the cluster names; on a local master, a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}/tidemark-store"  # in tests only
    return f"{base}/store-{__import__('uuid').uuid4().hex}"


def nations(spark, sf_dir) -> Engine:
    e = Engine(spark, scratch(spark))
    e.create("nation", NATION, table(spark, sf_dir, "nation"))
    return e


@op("dml_insert_select_values", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1 UNION ALL VALUES (900, 'NEW', NULL)")
def insert(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.insert("nation", table(spark, sf_dir, "nation").filter("n_regionkey = 1").select((c("n_nationkey") + 100).alias("n_nationkey"), F.upper("n_name").alias("n_name"), "n_regionkey"))
    e.insert("nation", spark.createDataFrame([(900, "NEW")], "n_nationkey int, n_name string"))
    return e.read("nation")


@op("dml_insert_ignore", "SELECT * FROM nation UNION ALL VALUES (901, 'A', 0)")
def insert_ignore(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.insert("nation", spark.createDataFrame([(1, "TAKEN", 0), (901, "A", 0), (None, "NULL KEY", 0)], NATION.schema()), ignore=True)
    return e.read("nation")


@op("dml_insert_auto_increment_default_generated", "SELECT row_number() OVER (ORDER BY r_regionkey) AS id, r_name AS name, 7 AS qty, r_name || '!' AS loud FROM region")
def auto_increment(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create("t", TableDef((Column("id", "long", False, auto_increment=True), Column("name", "string"), Column("qty", "int", default=7), Column("loud", "string", generated="concat(name, '!')")), ("id",)))
    e.insert("t", table(spark, sf_dir, "region").select(c("r_name").alias("name"), "r_regionkey"), order=[c("r_regionkey")])
    return e.read("t")


@op("dml_on_duplicate_key_update", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN n_name || '+' || n_name ELSE n_name END AS n_name, CASE WHEN n_nationkey < 3 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (950, 'X', 1)")
def upsert(spark, sf_dir):
    e = nations(spark, sf_dir)
    rows = table(spark, sf_dir, "nation").filter("n_nationkey < 3").unionByName(spark.createDataFrame([(950, "X", 1)], NATION.schema()))
    e.upsert("nation", rows, {"n_name": "concat(n_name, '+', new_n_name)", "n_regionkey": "n_regionkey + 10"})
    return e.read("nation")


@op("dml_upsert_second_unique", "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'NATION_5?!' WHEN n_nationkey = 6 THEN 'NATION_6*' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 5 THEN 4 WHEN n_nationkey = 6 THEN 6 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (960, 'NOWHERE', 1)")
def upsert_second_unique(spark, sf_dir):
    """Rows that meet others by the second key, by the first one, by a row that the statement inserts, and in turn."""
    e = Engine(spark, scratch(spark))
    e.create("nation", TableDef(NATION.columns, NATION.primary_key, (("n_name",),)), table(spark, sf_dir, "nation"))
    e.upsert("nation", spark.createDataFrame([(961, "NATION_5", 3), (5, "?", 1), (6, "*", 5)], NATION.schema()).coalesce(1), {"n_name": "CASE WHEN new_n_name = n_name THEN concat(n_name, '?') WHEN new_n_name = '?' THEN concat(n_name, '!') ELSE concat(n_name, new_n_name) END", "n_regionkey": "n_regionkey + CASE WHEN new_n_nationkey = 961 THEN 3 ELSE new_n_regionkey END"})
    e.upsert("nation", spark.createDataFrame([(960, "NOWHERE", 0), (962, "NOWHERE", 0)], NATION.schema()).coalesce(1), {"n_regionkey": "new_n_regionkey + 1"})
    return e.read("nation")


@op("dml_trigger_after_update", "SELECT n_nationkey AS k, n_regionkey AS was, n_regionkey + 5 AS now, 'update' AS what FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_regionkey, NULL, 'delete' FROM nation WHERE n_regionkey = 3 UNION ALL VALUES (970, NULL, 1, 'insert')")
def trigger_after_update(spark, sf_dir):
    """A log of what was inserted, updated and deleted, written by triggers."""
    e = nations(spark, sf_dir)
    e.create("log", TableDef((Column("k", "int"), Column("was", "int"), Column("now", "int"), Column("what", "string"))))
    none = F.lit(None).cast("int")
    e.trigger("nation", "after insert", lambda rows: e.insert("log", rows.select(c("n_nationkey").alias("k"), none.alias("was"), c("n_regionkey").alias("now"), F.lit("insert").alias("what"))))
    e.trigger("nation", "after update", lambda rows: e.insert("log", rows.select(c("n_nationkey").alias("k"), c("old_n_regionkey").alias("was"), c("n_regionkey").alias("now"), F.lit("update").alias("what"))))
    e.trigger("nation", "after delete", lambda rows: e.insert("log", rows.select(c("n_nationkey").alias("k"), c("n_regionkey").alias("was"), none.alias("now"), F.lit("delete").alias("what"))))
    e.insert("nation", spark.createDataFrame([(970, "NEW", 1)], NATION.schema()))
    e.update("nation", {"n_regionkey": "n_regionkey + 5"}, "n_regionkey = 2")
    e.delete("nation", "n_regionkey = 3")
    return e.read("log")


@op("dml_delete_self_reference", "WITH RECURSIVE gone(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey IN (4, 5) UNION SELECT n_nationkey FROM nation JOIN gone ON n_nationkey // 2 = gone.k AND n_nationkey > 1) SELECT n_nationkey AS k, CASE WHEN n_nationkey > 1 THEN (n_nationkey // 2)::INT END AS boss FROM nation WHERE n_nationkey > 0 AND n_nationkey NOT IN (SELECT k FROM gone)")
def delete_self_reference(spark, sf_dir):
    """A foreign key of a table to itself: all below the rows that go, go too."""
    e = Engine(spark, scratch(spark))
    k = c("n_nationkey")
    e.create("staff", TableDef((Column("k", "int", False), Column("boss", "int")), ("k",), foreign_keys=(ForeignKey(("boss",), "staff", ("k",), "cascade"),)), table(spark, sf_dir, "nation").filter("n_nationkey > 0").select(k.alias("k"), F.when(k > 1, F.floor(k / 2)).cast("int").alias("boss")))
    e.delete("staff", "k IN (4, 5)")
    return e.read("staff")


@op("dml_replace", "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'LAST' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 2 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (951, 'Y', 2)")
def replace(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.replace("nation", spark.createDataFrame([(2, "FIRST", 1), (2, "LAST", None), (951, "Y", 2)], NATION.schema()).coalesce(1))
    return e.read("nation")


@op("dml_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN n_regionkey + 5 ELSE n_regionkey END AS n_regionkey FROM nation")
def update(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.update("nation", {"n_name": "lower(n_name)", "n_regionkey": "n_regionkey + 5"}, "n_regionkey = 2")
    return e.read("nation")


@op("dml_update_order_limit", "SELECT n_nationkey, CASE WHEN row_number() OVER (PARTITION BY n_regionkey = 3 ORDER BY n_name DESC) <= 2 AND n_regionkey = 3 THEN 'hit' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_limit(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.update("nation", {"n_name": F.lit("hit")}, "n_regionkey = 3", [F.desc("n_name")], 2)
    return e.read("nation")


@op("dml_update_correlated", "SELECT n_nationkey, n_name, (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey)::INT AS n_regionkey FROM nation")
def update_correlated(spark, sf_dir):
    """A correlated sub-query in SET: rows without a match become NULL."""
    e = nations(spark, sf_dir)
    most = table(spark, sf_dir, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.max("s_suppkey").alias("m"))
    e.update_join("nation", e.read("nation").select("n_nationkey").join(most, "n_nationkey", "left"), ["n_nationkey"], {"n_regionkey": "o_m"})
    return e.read("nation")


@op("dml_update_multi_table", "SELECT n_nationkey, CASE WHEN r_name IS NOT NULL THEN r_name || ':' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) r ON r_regionkey = n_regionkey")
def update_multi(spark, sf_dir):
    e = nations(spark, sf_dir)
    other = table(spark, sf_dir, "region").filter("r_regionkey < 2").select(c("r_regionkey").alias("n_regionkey"), "r_name")
    e.update_join("nation", other, ["n_regionkey"], {"n_name": "concat(o_r_name, ':', n_name)"})
    return e.read("nation")


@op("dml_delete", "SELECT * FROM nation WHERE NOT coalesce(n_regionkey = 4 AND n_name > 'I', false)")
def delete(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.delete("nation", "n_regionkey = 4 AND n_name > 'I'")
    return e.read("nation")


@op("dml_delete_order_limit", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 22")
def delete_limit(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.delete("nation", "true", [F.desc("n_nationkey")], 3)
    return e.read("nation")


@op("dml_delete_multi_table", "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def delete_multi(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.delete_join("nation", table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(c("s_nationkey").alias("n_nationkey")), ["n_nationkey"])
    return e.read("nation")


@op("dml_truncate", "SELECT 0 AS n, 1 AS next_id")
def truncate(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.truncate("nation")
    return e.read("nation").agg(F.count("*").alias("n")).withColumn("next_id", F.lit(e.tables["nation"].next_id))


@op("dml_foreign_key_cascade", "SELECT * FROM nation WHERE n_regionkey <> 1")
def cascade(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create("region", REGION, table(spark, sf_dir, "region"))
    e.create("nation", TableDef(NATION.columns, NATION.primary_key, foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "cascade"),)), table(spark, sf_dir, "nation"))
    e.delete("region", "r_regionkey = 1")
    return e.read("nation")


@op("ddl_create_as_alter", "SELECT n_nationkey::BIGINT AS id, n_name, n_regionkey, n_nationkey * 2 AS twice FROM nation")
def alter(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.create_as("copy", e.sql("SELECT * FROM {nation}"))
    e.add_column("copy", Column("twice", "int", generated="n_nationkey * 2"))
    e.add_column("copy", Column("gone", "string", default="x"))
    e.drop_column("copy", "gone")
    e.change_column("copy", "twice", Column("twice", "int"))
    e.change_column("copy", "n_nationkey", Column("id", "long"))
    e.rename(("copy", "moved"))
    return e.read("moved")


@op("ddl_view_catalog", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'int', 'NO', 'PRI'), ('nation', 'n_name', 2, 'string', 'YES', ''), ('nation', 'n_regionkey', 3, 'int', 'YES', '')) t(table_name, column_name, ordinal_position, data_type, is_nullable, column_key)")
def catalog(spark, sf_dir):
    return nations(spark, sf_dir).describe("nation")


def family(spark, sf_dir) -> Engine:
    e = Engine(spark, scratch(spark))
    e.create("region", TableDef(REGION.columns, REGION.primary_key, (("r_name",),)), table(spark, sf_dir, "region"))
    e.create("nation", TableDef(NATION.columns, NATION.primary_key, checks=("n_nationkey >= 0",), foreign_keys=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",), "cascade"),)), table(spark, sf_dir, "nation"))
    return e


@op("catalog_constraints", "SELECT * FROM (VALUES ('region', 'PRIMARY', 'PRIMARY KEY', 'r_regionkey', NULL, NULL), ('region', 'unique_1', 'UNIQUE', 'r_name', NULL, NULL), ('nation', 'PRIMARY', 'PRIMARY KEY', 'n_nationkey', NULL, NULL), ('nation', 'fk_1', 'FOREIGN KEY', 'n_regionkey', 'region', 'CASCADE'), ('nation', 'check_1', 'CHECK', NULL, NULL, NULL)) t(table_name, constraint_name, constraint_type, column_name, parent, delete_rule)")
def catalog_constraints(spark, sf_dir):
    """INFORMATION_SCHEMA: constraints with their columns and rules."""
    e = family(spark, sf_dir)
    name = ["table_name", "constraint_name"]
    columns = e.information_schema("key_column_usage").select(*name, "column_name", c("referenced_table_name").alias("parent"))
    rules = e.information_schema("referential_constraints").select(*name, "delete_rule")
    return e.information_schema("table_constraints").join(columns, name, "left").join(rules, name, "left")


@op("show_tables_index", "SELECT * FROM (VALUES ('region', 'PRIMARY', 1, 'r_regionkey'), ('region', 'unique_1', 1, 'r_name')) t(table_name, key_name, seq_in_index, column_name)")
def show_tables_index(spark, sf_dir):
    """SHOW TABLES LIKE and SHOW INDEX."""
    e = family(spark, sf_dir)
    return e.show_tables("REG%").select("table_name").join(e.show_index("region"), "table_name")


@op("ddl_order_by_checksum", "SELECT 'nation' AS table_name, true AS same UNION ALL SELECT 'missing', NULL")
def order_by_checksum(spark, sf_dir):
    """ALTER TABLE ... ORDER BY moves rows only: CHECKSUM TABLE stays."""
    e = nations(spark, sf_dir)
    before = e.checksum("nation", "missing").withColumnRenamed("checksum", "old")
    e.order_by("nation", F.desc("n_name"))
    return before.join(e.checksum("nation", "missing"), "table_name").select("table_name", (c("old") == c("checksum")).alias("same"))


@op("ddl_view_read", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def view(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.create_view("per_region", "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey")
    return e.read("per_region")


@op("snapshot_restore_rollback", "SELECT * FROM nation WHERE n_nationkey <> 3")
def snapshots(spark, sf_dir):
    e = nations(spark, sf_dir)
    e.delete("nation", "n_nationkey = 3")
    e.snapshot("s")
    e.truncate("nation")
    e.restore("s")
    e.begin()
    e.update("nation", {"n_name": F.lit("x")})
    e.savepoint("p")
    e.delete("nation")
    e.rollback("p")
    e.rollback()
    return e.read("nation")


@op("scan_partition_selection", "SELECT * FROM orders WHERE o_orderkey % 4 IN (1, 3)")
def partitions(spark, sf_dir):
    """FROM orders PARTITION (p1, p3): the partition's condition becomes a filter on the scan."""
    conditions = {f"p{i}": f"o_orderkey % 4 = {i}" for i in range(4)}
    keep = F.expr(" OR ".join(conditions[p] for p in ("p1", "p3")))
    return table(spark, sf_dir, "orders").filter(keep)


@op("outfile_escapes_round_trip", """SELECT * FROM (VALUES (1, 'a|b', 'x'), (2, 'two' || chr(10) || 'lines', ''), (3, '', 'y'), (4, NULL, 'z'), (5, chr(92) || 'N', chr(92)), (6, 'tab' || chr(9) || chr(13), 'q"uote'), (7, '|', '||')) t(k, a, b)""")
def outfile_escapes(spark, sf_dir):
    """INTO OUTFILE and LOAD DATA: separators, line feeds, '', NULL, the text of \\N and backslashes come back as they were."""
    rows = [(1, "a|b", "x"), (2, "two\nlines", ""), (3, "", "y"), (4, None, "z"), (5, "\\N", "\\"), (6, "tab\t\r", 'q"uote'), (7, "|", "||")]
    path = f"{scratch(spark)}/escapes"
    into_outfile(spark.createDataFrame(rows, "k int, a string, b string"), path, sep="|")
    return load_data(spark, path, "k int, a string, b string", sep="|")


@op("load_data_infile", "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS r, upper(n_name) AS up FROM nation")
def load(spark, sf_dir):
    """INTO OUTFILE, then LOAD DATA INFILE with a SET column; NULLs go through as \\N."""
    path = f"{scratch(spark)}/nation"
    into_outfile(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(c("n_regionkey") != 2, c("n_regionkey"))), path, sep="|")
    return load_data(spark, path, "k int, name string, r int", sep="|", set_={"up": F.upper("name")})
