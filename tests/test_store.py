import pytest
from pyspark.sql import functions as F

from tidemark.store import Column, ConstraintError, Engine, ForeignKey, TableDef

T = TableDef((Column("id", "int", False), Column("v", "int"), Column("e", "string", members=("a", "b"))), ("id",), (("v",),), ("v < 100",))


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.create("t", T, spark.createDataFrame([(1, 10, "a"), (2, None, None)], T.schema()))
    return e


def rows(e, name="t"):
    return sorted(map(tuple, e.read(name).collect()), key=str)


@pytest.mark.parametrize("row", [(1, 5, "a"), (None, 5, "a"), (3, 10, "a"), (3, 100, "a"), (3, 5, "z")])
def test_a_broken_constraint_changes_nothing(spark, engine, row):
    before = rows(engine)
    with pytest.raises(ConstraintError):
        engine.insert("t", spark.createDataFrame([row], T.schema()))
    assert rows(engine) == before


def test_unknown_passes_a_check_and_nulls_a_unique_key(spark, engine):
    engine.insert("t", spark.createDataFrame([(3, None, "b")], T.schema()))
    assert len(rows(engine)) == 3


def test_update_left_to_right_and_changed_rows(engine):
    r = engine.update("t", {"id": "id + 10", "v": "id"}, "v = 10")
    assert r.changed == 1 and rows(engine) == [(11, 11, "a"), (2, None, None)]
    assert engine.update("t", {"v": "v"}).changed == 0


def test_upsert_counts_and_order(spark, engine):
    offered = spark.createDataFrame([(1, 20, "a"), (1, 30, "a"), (5, 1, "b"), (5, 2, "b")], T.schema()).coalesce(1)
    r = engine.upsert("t", offered, {"v": "coalesce(v, 0) + new_v"})
    assert (r.inserted, r.changed) == (1, 3)
    assert rows(engine) == [(1, 60, "a"), (2, None, None), (5, 3, "b")]


@pytest.mark.parametrize("action, left", [("cascade", []), ("set null", [(7, None)]), ("restrict", None)])
def test_foreign_keys(spark, engine, action, left):
    engine.create("c", TableDef((Column("k", "int"), Column("t_id", "int")), foreign_keys=(ForeignKey(("t_id",), "t", ("id",), action),)), spark.createDataFrame([(7, 1)], "k int, t_id int"))
    with pytest.raises(ConstraintError):
        engine.insert("c", spark.createDataFrame([(8, 99)], "k int, t_id int"))
    if left is None:
        with pytest.raises(ConstraintError):
            engine.delete("t", "id = 1")
        assert len(rows(engine)) == 2
    else:
        engine.delete("t", "id = 1")
        assert rows(engine, "c") == left


def test_snapshots_transactions_and_savepoints(spark, engine):
    engine.snapshot("s")
    engine.begin()
    engine.delete("t", "id = 1")
    engine.savepoint("p")
    engine.truncate("t")
    engine.rollback("p")
    assert len(rows(engine)) == 1
    engine.rollback()
    assert len(rows(engine)) == 2
    engine.truncate("t")
    engine.restore("s")
    assert len(rows(engine)) == 2


def test_auto_increment_goes_on_and_truncate_resets(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.create("a", TableDef((Column("id", "long", False, auto_increment=True), Column("x", "int")), ("id",)))
    e.insert("a", spark.range(5).select(F.col("id").cast("int").alias("x")), order=[F.desc("x")])
    r = e.insert("a", spark.createDataFrame([(9,)], "x int"))
    assert r.insert_id == 6 and rows(e, "a") == [(1, 4), (2, 3), (3, 2), (4, 1), (5, 0), (6, 9)]
    e.truncate("a")
    assert e.insert("a", spark.createDataFrame([(9,)], "x int")).insert_id == 1


def test_triggers_views_and_partitions(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.create("p", TableDef((Column("a", "int"), Column("b", "string")), partition_by=("a", {"p0": "a < 10", "p1": "a >= 10"})))
    e.trigger("p", "before insert", lambda new: new.withColumn("b", F.upper("b")))
    e.insert("p", spark.createDataFrame([(1, "x"), (20, "y")], "a int, b string"))
    assert [tuple(r) for r in e.read("p", ("p1",)).collect()] == [(20, "Y")]
    e.create_view("v", "SELECT count(*) AS n FROM {p}")
    assert e.read("v").first().n == 2


def test_upsert_by_any_key_writes_once(spark, engine):
    before = engine.tables["t"].version
    offered = spark.createDataFrame([(7, 10, "b"), (1, 11, "a"), (2, 12, "b"), (8, 13, "a"), (9, 13, "b"), (8, 14, "a")], T.schema()).coalesce(1)
    r = engine.upsert("t", offered, {"e": "new_e", "v": "coalesce(v, 50) + 1"})
    assert (r.inserted, r.changed) == (1, 5) and engine.tables["t"].version == before + 1
    assert rows(engine) == [(1, 12, "a"), (2, 51, "b"), (8, 15, "a")]


def test_upsert_that_breaks_a_key_changes_nothing(spark, engine):
    before = rows(engine)
    with pytest.raises(ConstraintError):
        engine.upsert("t", spark.createDataFrame([(2, 5, "a")], T.schema()), {"v": F.lit(10)})
    assert rows(engine) == before


def test_a_failing_trigger_undoes_its_statement(spark, engine):
    engine.create("log", TableDef((Column("id", "int"),), ("id",)), spark.createDataFrame([(5,)], "id int"))
    engine.trigger("t", "after insert", lambda new: engine.insert("log", new.select("id")))
    engine.insert("t", spark.createDataFrame([(4, 1, "a")], T.schema()))
    assert rows(engine, "log") == [(4,), (5,)]
    with pytest.raises(ConstraintError):
        engine.insert("t", spark.createDataFrame([(5, 2, "a")], T.schema()))
    assert len(rows(engine)) == 3 and rows(engine, "log") == [(4,), (5,)]


def test_before_update_trigger_sees_old_values(engine):
    engine.trigger("t", "before update", lambda hit: hit.withColumn("v", F.col("old_v") + F.col("v")))
    assert engine.update("t", {"v": F.lit(1)}, "id = 1").changed == 1
    assert rows(engine) == [(1, 11, "a"), (2, None, None)]


@pytest.mark.parametrize("action, left", [("cascade", [(4, None)]), ("set null", [(2, None), (3, 2), (4, None)]), ("restrict", None)])
def test_foreign_keys_of_a_table_to_itself(spark, engine, action, left):
    engine.create("s", TableDef((Column("k", "int"), Column("up", "int")), ("k",), foreign_keys=(ForeignKey(("up",), "s", ("k",), action),)), spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "k int, up int"))
    if left is None:
        with pytest.raises(ConstraintError):
            engine.delete("s", "k = 1")
        assert len(rows(engine, "s")) == 4
    else:
        engine.delete("s", "k = 1")
        assert rows(engine, "s") == left


def test_show_create_checksum_and_order(spark, engine):
    text = engine.show_create("t")
    assert "`id` int NOT NULL" in text and "PRIMARY KEY (`id`)" in text and "UNIQUE KEY (`v`)" in text and "CHECK (v < 100)" in text
    old = engine.checksum("t", "none").collect()
    engine.order_by("t", F.desc("id"))
    assert engine.checksum("t", "none").collect() == old
    assert dict(map(tuple, old))["none"] is None
    engine.update("t", {"v": F.lit(11)}, "id = 1")
    assert engine.checksum("t").head().checksum != old[0].checksum
    with pytest.raises(KeyError):
        engine.information_schema("nothing")
