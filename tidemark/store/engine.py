"""Tables as versioned Parquet folders.

A change computes a new version of a table as a DataFrame, validates it, writes it, and moves the table's pointer last;
readers see a whole version or the one before. A snapshot is a map from tables to versions. There is one writer.
Files are written by Spark, so the root may be in any store that Spark writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: When triggers fire.
WHEN = ("before insert", "before update", "after insert", "after update", "after delete")


class ConstraintError(ValueError):
    """A change that would break a constraint; the table stays as it was."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: object = None
    auto_increment: bool = False
    generated: str | None = None
    on_update: str | None = None
    members: tuple[str, ...] = ()  # of an ENUM


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "restrict"  # restrict, cascade, set null


@dataclass(frozen=True)
class TableDef:
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    partition_by: tuple[str, dict[str, str]] | None = None  # column, {partition name: condition}

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.type), True) for c in self.columns])

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.primary_key, *self.unique) if k]


@dataclass
class _Table:
    definition: TableDef
    version: int = 0
    next_id: int = 1


@dataclass
class Result:
    """What a change did: rows inserted, changed and deleted, and the first number that auto_increment gave."""

    inserted: int = 0
    changed: int = 0
    deleted: int = 0
    insert_id: int | None = None


@dataclass
class Engine:
    spark: SparkSession
    root: str
    tables: dict[str, _Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    snapshots: dict[str, dict] = field(default_factory=dict)
    triggers: dict[tuple[str, str], list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    _open: list[tuple[str, dict]] = field(default_factory=list)
    _written: dict[str, int] = field(default_factory=dict)

    # -- definitions ----------------------------------------------------------------------------------------------
    def create(self, name: str, definition: TableDef, rows: DataFrame | None = None, if_not_exists: bool = False) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self.tables[name] = _Table(definition)
        self._commit(name, self.spark.createDataFrame([], definition.schema()))
        if rows is not None:
            try:
                self.insert(name, rows)
            except Exception:
                del self.tables[name]
                raise

    def create_like(self, name: str, other: str) -> None:
        self.create(name, self.tables[other].definition)

    def create_as(self, name: str, rows: DataFrame) -> None:
        self.create(name, TableDef(tuple(Column(f.name, f.dataType.simpleString(), f.nullable) for f in rows.schema)), rows)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name in self.tables:
            del self.tables[name]
        elif not if_exists:
            raise KeyError(name)

    def rename(self, *pairs: tuple[str, str]) -> None:
        """Several renames at once; a name that is still taken at the end is an error and nothing changes."""
        moved = dict(self.tables)
        for old, new in pairs:
            if new in moved:
                raise ValueError(f"table {new} exists")
            moved[new] = moved.pop(old)
        self.tables = moved
        self._paths = {**getattr(self, "_paths", {}), **{new: self._path_name(old) for old, new in pairs}}

    def create_view(self, name: str, text: str, replace_it: bool = False) -> None:
        if name in self.views and not replace_it:
            raise ValueError(f"view {name} exists")
        self.views[name] = text

    def drop_view(self, name: str) -> None:
        del self.views[name]

    # -- reading --------------------------------------------------------------------------------------------------
    def _path_name(self, name: str) -> str:
        return getattr(self, "_paths", {}).get(name, name)

    def read(self, name: str, partitions: tuple[str, ...] = ()) -> DataFrame:
        """The current version of a table, or of its named partitions only, or a view."""
        if name in self.views:
            return self.sql(self.views[name])
        t = self.tables[name]
        df = self.spark.read.schema(t.definition.schema()).parquet(f"{self.root}/{self._path_name(name)}/v={t.version}")
        if partitions:
            _, conditions = t.definition.partition_by
            keep = F.lit(False)
            for p in partitions:
                keep = keep | F.coalesce(F.expr(conditions[p]), F.lit(False))
            df = df.filter(keep)
        return df

    def sql(self, text: str, **parameters) -> DataFrame:
        """A SELECT whose {name} fields stand for tables and views of this engine."""
        import string

        used = {n for _, n, _, _ in string.Formatter().parse(text) if n}
        return self.spark.sql(text, args=parameters or None, **{n: self.read(n) for n in used})

    # -- writing --------------------------------------------------------------------------------------------------
    def _stage(self, df: DataFrame) -> DataFrame:
        """df as a table of its own below the root, so that rows that several steps read are made once."""
        place = f"{self.root}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def _commit(self, name: str, df: DataFrame) -> None:
        t = self.tables[name]
        place = self._path_name(name)
        version = self._written.get(place, 0) + 1
        df.select(*(F.col(c.name).cast(c.type) for c in t.definition.columns)).write.parquet(f"{self.root}/{place}/v={version}")
        self._written[place] = version
        t.version = version  # the pointer moves last

    def _validate(self, name: str, df: DataFrame) -> None:
        d = self.tables[name].definition
        for c in d.columns:
            if (not c.nullable or c.name in d.primary_key) and df.filter(F.col(c.name).isNull()).limit(1).count():
                raise ConstraintError(f"{name}.{c.name} can't be null")
            if c.members and df.filter(~F.col(c.name).isin(*c.members)).limit(1).count():
                raise ConstraintError(f"{name}.{c.name} isn't one of its members")
        for check in d.checks:
            if df.filter(f"NOT ({check})").limit(1).count():
                raise ConstraintError(f"{name}: {check}")
        for key in d.keys():
            some = df.dropna(subset=list(key))
            if some.groupBy(*key).count().filter("count > 1").limit(1).count():
                raise ConstraintError(f"{name}: duplicate {key}")
        for fk in d.foreign_keys:
            parent = df if fk.parent == name else self.read(fk.parent)
            parent = parent.select(*(F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True))).distinct()
            if df.dropna(subset=list(fk.columns)).join(parent, list(fk.columns), "left_anti").limit(1).count():
                raise ConstraintError(f"{name}: {fk.columns} isn't in {fk.parent}")

    def _replace(self, name: str, df: DataFrame) -> None:
        """Write a version first and validate what is written; the pointer goes back if it breaks a constraint."""
        t = self.tables[name]
        before = t.version
        self._commit(name, df)
        try:
            self._validate(name, self.read(name))
        except ConstraintError:
            t.version = before
            raise

    def _complete(self, name: str, rows: DataFrame, order: list[Col] | None = None) -> tuple[DataFrame, int | None]:
        """Rows with all columns: defaults, numbers of auto_increment (in the order given), generated columns."""
        t = self.tables[name]
        first = None
        for c in t.definition.columns:
            if c.generated:
                continue
            if c.auto_increment:
                own = F.col(c.name).cast("long") if c.name in rows.columns else F.lit(None).cast("long")
                first = t.next_id
                rows = numbered(rows.orderBy(*order) if order else rows, "_number", self._stage).withColumn(c.name, F.coalesce(own, F.col("_number") + F.lit(first))).drop("_number")
            elif c.name not in rows.columns:
                value = c.default if isinstance(c.default, Col) else F.lit(c.default)
                rows = rows.withColumn(c.name, value.cast(c.type))
        for c in t.definition.columns:
            if c.generated:
                rows = rows.withColumn(c.name, F.expr(c.generated))
        for f in self.triggers.get((name, "before insert"), []):
            rows = f(rows)
        return rows.select(*(F.col(c.name).cast(c.type).alias(c.name) for c in t.definition.columns)), first

    def _advance(self, name: str) -> None:
        t = self.tables[name]
        for c in t.definition.columns:
            if c.auto_increment:
                t.next_id = max(t.next_id, (self.read(name).agg(F.max(c.name)).first()[0] or 0) + 1)

    def _conflict(self, a: DataFrame, b: DataFrame, key: tuple[str, ...]) -> list[Col]:
        return [a[k] == b[k] for k in key]

    def insert(self, name: str, rows: DataFrame, ignore: bool = False, order: list[Col] | None = None) -> Result:
        """INSERT VALUES / SELECT; with ignore, rows that are null where they must not be or whose key is taken are left out."""
        d = self.tables[name].definition
        new, first = self._complete(name, rows, order)
        old = self.read(name)
        if ignore:  # of equal keys the first row stays
            new = (new.orderBy(*order) if order else new).withColumn("_n", F.monotonically_increasing_id())
            required = [c.name for c in d.columns if not c.nullable or c.name in d.primary_key]
            new = new.dropna(subset=required) if required else new
            for key in d.keys():
                place = F.row_number().over(Window.partitionBy(*key).orderBy("_n"))
                has = F.lit(True)
                for k in key:
                    has = has & F.col(k).isNotNull()
                new = new.withColumn("_p", place).filter(~has | (F.col("_p") == 1)).drop("_p").join(old.select(*key), list(key), "left_anti")
            new = new.select(*(c.name for c in d.columns))
        new = self._stage(new)  # made once, counted and written from there
        with self._whole():
            self._replace(name, old.unionByName(new))
            self._advance(name)
            self._after(name, "insert", new)
        return Result(inserted=new.count(), insert_id=first)

    def replace(self, name: str, rows: DataFrame, order: list[Col] | None = None) -> Result:
        """REPLACE: rows that conflict on any key go, of new rows with one key the last stays."""
        d = self.tables[name].definition
        new, first = self._complete(name, rows, order)
        new = new.orderBy(*order) if order else new
        for key in d.keys():
            new = new.withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_n")))).filter("_p = 1").drop("_n", "_p")
        old = kept = self.read(name)
        for key in d.keys():
            kept = kept.join(new.select(*key), list(key), "left_anti").select(*(c.name for c in d.columns))
        gone = old.count() - kept.count()
        self._replace(name, kept.unionByName(new))
        self._advance(name)
        return Result(inserted=new.count(), deleted=gone, insert_id=first)

    def upsert(self, name: str, rows: DataFrame, updates: dict[str, Col | str], order: list[Col] | None = None) -> Result:
        """INSERT ... ON DUPLICATE KEY UPDATE: in an update, a column is the old value and new_<column> the offered one.

        A row that meets one by any key (of several, the first in the order of keys) updates it, else it is inserted;
        rows count in the order given, so of offered rows with one key the first may be inserted and the others update
        it. Updates go left to right. Only the rows that some offer meets are worked on: in each turn those offers
        whose key and target no earlier one shares, so turns are as many as the most offers of one key; the table is
        written once. An update that alters a key is seen from the next turn on.
        """
        d = self.tables[name].definition
        keys, names = d.keys(), [c.name for c in d.columns]
        if not keys:
            return self.insert(name, rows, order=order)
        new, first = self._complete(name, rows.orderBy(*order) if order else rows, order)
        pending = self._stage(new.withColumn("_n", F.monotonically_increasing_id()))
        old = self.read(name).select(*names, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_id"))
        met = [old.join(pending.select(*key).dropna().distinct(), list(key), "left_semi").select(*names, "_id") for key in keys]
        work = self._stage(reduce(DataFrame.unionByName, met).dropDuplicates(["_id"]))
        changed = inserted = 0
        while True:
            p, free, target = pending, F.lit(True), F.lit(None).cast(work.schema["_id"].dataType)
            for i, key in enumerate(keys):
                p = p.join(pending.dropna(subset=list(key)).groupBy(*key).agg(F.min("_n").alias(f"_first{i}")), list(key), "left")
                p = p.join(work.select(*key, F.col("_id").alias(f"_met{i}")), list(key), "left")
                free, target = free & F.coalesce(F.col(f"_first{i}") == F.col("_n"), F.lit(True)), F.coalesce(target, F.col(f"_met{i}"))
            p = p.select(*names, "_n", free.alias("_free"), target.alias("_id"))
            least = p.dropna(subset=["_id"]).groupBy("_id").agg(F.min("_n").alias("_least"))
            p = self._stage(p.join(least, "_id", "left").withColumn("_free", F.col("_free") & F.coalesce(F.col("_least") == F.col("_n"), F.lit(True))).drop("_least"))
            counts = p.agg(F.count_if(F.col("_free") & F.col("_id").isNotNull()), F.count_if(F.col("_free") & F.col("_id").isNull()), F.count_if(~F.col("_free"))).first()
            if not counts[0] + counts[1]:
                break
            changed, inserted = changed + counts[0], inserted + counts[1]
            own = F.struct(F.lit("").alias("file"), F.col("_n").alias("row"))
            offered = p.filter("_free").select(F.coalesce("_id", own).alias("_id"), F.col("_id").isNull().alias("_insert"), *(F.col(c).alias(f"new_{c}") for c in names))
            both = work.join(offered, "_id", "full")
            both = both.select("_id", F.coalesce("_insert", F.lit(False)).alias("_insert"), F.col("_insert").isNotNull().alias("_hit"), *names, *(f"new_{c}" for c in names))
            for c in names:
                both = both.withColumn(c, F.when(F.col("_insert"), F.col(f"new_{c}")).otherwise(F.col(c)))
            for c, v in updates.items():
                both = both.withColumn(c, F.when(F.col("_hit") & ~F.col("_insert"), (F.expr(v) if isinstance(v, str) else v).cast(d.column(c).type)).otherwise(F.col(c)))
            for c in d.columns:
                if c.generated:
                    both = both.withColumn(c.name, F.expr(c.generated).cast(c.type))
            work = self._stage(both.select(*names, "_id"))
            if not counts[2]:
                break
            pending = p.filter("not _free").select(*names, "_n")
        self._replace(name, old.join(work.select("_id"), "_id", "left_anti").select(*names).unionByName(work.select(*names)))
        self._advance(name)
        return Result(inserted=inserted, changed=changed, insert_id=first)

    def _limited(self, df: DataFrame, condition: Col, order: list[Col] | None, limit: int | None, key: tuple[str, ...] = ()) -> tuple[DataFrame, Col]:
        """df with the rows that a change hits: those of the condition, with a limit the first ones in the order."""
        hit = F.coalesce(condition, F.lit(False))
        if limit is None:
            return df, hit
        if key:  # the first rows by a top-k, marked by their key
            first = df.filter(hit).orderBy(*(order or []), *key).limit(limit).select(*key, F.lit(True).alias("_first"))
            return df.join(first, list(key), "left"), F.coalesce("_first", F.lit(False))
        place = F.row_number().over(Window.partitionBy(hit).orderBy(*(order or [F.lit(1)])))
        return df.withColumn("_place", place), hit & (F.col("_place") <= limit)

    def update(self, name: str, values: dict[str, Col | str], where: Col | str = "true", order: list[Col] | None = None, limit: int | None = None) -> Result:
        """UPDATE ... SET (left to right: later values see earlier ones) WHERE ... ORDER BY ... LIMIT."""
        d = self.tables[name].definition
        df, hit = self._limited(self.read(name), F.expr(where) if isinstance(where, str) else where, order, limit, d.primary_key)
        df = df.withColumn("_hit", hit)
        old = {c.name: f"_old_{c.name}" for c in d.columns}
        df = df.select("*", *(F.col(c).alias(o) for c, o in old.items()))
        for c, v in values.items():
            df = df.withColumn(c, F.when(F.col("_hit"), (F.expr(v) if isinstance(v, str) else v).cast(d.column(c).type)).otherwise(F.col(c)))
        for c in d.columns:
            if c.on_update and c.name not in values:
                df = df.withColumn(c.name, F.when(F.col("_hit"), F.expr(c.on_update).cast(c.type)).otherwise(F.col(c.name)))
            if c.generated:
                df = df.withColumn(c.name, F.expr(c.generated).cast(c.type))
        differs = F.lit(False)
        for c, o in old.items():
            differs = differs | ~F.col(c).eqNullSafe(F.col(o))
        df = df.toDF(*(f"old_{c[5:]}" if c in old.values() else c for c in df.columns)) if self._fires(name, "update") else df
        if before := self.triggers.get((name, "before update")):
            hit_rows = reduce(lambda rows, f: f(rows), before, df.filter("_hit"))
            df = df.filter("not _hit").unionByName(hit_rows.select(*df.columns))
        if self._fires(name, "update"):
            df = self._stage(df)
            differs = reduce(lambda a, c: a | ~F.col(c).eqNullSafe(F.col(f"old_{c}")), old, F.lit(False))
        n = df.filter(F.col("_hit") & differs).count()
        with self._whole():
            self._replace(name, df)
            self._after(name, "update", df.filter("_hit").select(*old, *(f"old_{c}" for c in old)) if self._fires(name, "update") else None)
        return Result(changed=n)

    def update_join(self, name: str, other: DataFrame, on: list[str], values: dict[str, Col | str]) -> Result:
        """Multi-table UPDATE: other's columns are o_<column>; of several matches the first by its columns counts."""
        d = self.tables[name].definition
        rest = [c for c in other.columns if c not in on]
        one = other.withColumn("_p", F.row_number().over(Window.partitionBy(*on).orderBy(*rest or [F.lit(1)]))).filter("_p = 1").drop("_p")
        one = one.select(*on, *(F.col(c).alias(f"o_{c}") for c in rest), F.lit(True).alias("_hit"))
        df = self.read(name).join(one, on, "left")
        for c, v in values.items():
            df = df.withColumn(c, F.when(F.col("_hit"), (F.expr(v) if isinstance(v, str) else v).cast(d.column(c).type)).otherwise(F.col(c)))
        n = df.filter("_hit").count()
        self._replace(name, df)
        return Result(changed=n)

    def delete(self, name: str, where: Col | str = "true", order: list[Col] | None = None, limit: int | None = None) -> Result:
        """DELETE ... WHERE ... ORDER BY ... LIMIT, with the actions of foreign keys that refer to the rows."""
        df, hit = self._limited(self.read(name), F.expr(where) if isinstance(where, str) else where, order, limit, self.tables[name].definition.primary_key)
        columns = [c.name for c in self.tables[name].definition.columns]
        gone = df.filter(hit).select(*columns)
        return self._remove(name, df.filter(~hit).select(*columns), gone)

    def delete_join(self, name: str, other: DataFrame, on: list[str]) -> Result:
        """Multi-table DELETE of the rows with a match in other."""
        df = self.read(name)
        return self._remove(name, df.join(other, on, "left_anti").select(*df.columns), df.join(other, on, "left_semi").select(*df.columns))

    def _own_references(self, name: str, kept: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Foreign keys of a table to itself: rows that refer to ones that go, go too (turn by turn) or lose the reference."""
        own = [fk for fk in self.tables[name].definition.foreign_keys if fk.parent == name]
        newest = gone
        while own:
            newest, fresh = None, newest
            for fk in own:
                keys = fresh.select(*(F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True))).dropna().distinct()
                if fk.on_delete == "set null":
                    hit = kept.join(keys.withColumn("_hit", F.lit(True)), list(fk.columns), "left")
                    for c in fk.columns:
                        hit = hit.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c)))
                    kept = hit.select(*gone.columns)
                elif fk.on_delete == "cascade":
                    more = self._stage(kept.join(keys, list(fk.columns), "left_semi").select(*gone.columns))
                    if not more.isEmpty():
                        kept = self._stage(kept.join(keys, list(fk.columns), "left_anti").select(*gone.columns))
                        gone, newest = gone.unionByName(more), more if newest is None else newest.unionByName(more)
            if newest is None:
                break
        return kept, gone

    def _remove(self, name: str, kept: DataFrame, gone: DataFrame) -> Result:
        kept, gone = self._own_references(name, kept, gone)
        n = gone.count()
        with self._whole():
            for child, t in list(self.tables.items()):
                for fk in t.definition.foreign_keys:
                    if fk.parent != name or child == name:
                        continue
                    keys = gone.select(*(F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True))).distinct()
                    rows = self.read(child)
                    if not rows.join(keys, list(fk.columns), "left_semi").limit(1).count():
                        continue
                    if fk.on_delete == "cascade":
                        self.delete_join(child, keys, list(fk.columns))
                    elif fk.on_delete == "set null":
                        hit = rows.join(keys.withColumn("_hit", F.lit(True)), list(fk.columns), "left")
                        for c in fk.columns:
                            hit = hit.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c)))
                        self._commit(child, hit)
                    else:
                        raise ConstraintError(f"{child} refers to rows of {name}")
            self._replace(name, kept)
            self._after(name, "delete", gone)
        return Result(deleted=n)

    def truncate(self, name: str) -> None:
        self._commit(name, self.spark.createDataFrame([], self.tables[name].definition.schema()))
        self.tables[name].next_id = 1

    # -- ALTER TABLE ----------------------------------------------------------------------------------------------
    def _alter(self, name: str, columns: tuple[Column, ...], df: DataFrame, **changes) -> None:
        before = self.tables[name].definition
        self.tables[name].definition = replace(before, columns=columns, **changes)
        try:
            self._replace(name, df)
        except Exception:
            self.tables[name].definition = before
            raise

    def add_column(self, name: str, column: Column) -> None:
        value = F.expr(column.generated) if column.generated else column.default if isinstance(column.default, Col) else F.lit(column.default)
        d = self.tables[name].definition
        self._alter(name, (*d.columns, column), self.read(name).withColumn(column.name, value.cast(column.type)))

    def drop_column(self, name: str, column: str) -> None:
        d = self.tables[name].definition
        self._alter(name, tuple(c for c in d.columns if c.name != column), self.read(name).drop(column), primary_key=() if column in d.primary_key else d.primary_key, unique=tuple(k for k in d.unique if column not in k))

    def change_column(self, name: str, old: str, new: Column) -> None:
        """MODIFY and CHANGE: another name, type or default; values are cast, and a value that can't be is an error."""
        d = self.tables[name].definition
        swap = lambda key: tuple(new.name if c == old else c for c in key)
        self._alter(name, tuple(new if c.name == old else c for c in d.columns), self.read(name).withColumnRenamed(old, new.name), primary_key=swap(d.primary_key), unique=tuple(map(swap, d.unique)))

    def add_unique(self, name: str, key: tuple[str, ...]) -> None:
        d = self.tables[name].definition
        self._alter(name, d.columns, self.read(name), unique=(*d.unique, key))

    def add_check(self, name: str, condition: str) -> None:
        d = self.tables[name].definition
        self._alter(name, d.columns, self.read(name), checks=(*d.checks, condition))

    def order_by(self, name: str, *order: Col | str) -> None:
        """ALTER TABLE ... ORDER BY: the files hold the rows in ranges of this order, so that scans of a range skip files."""
        d = self.tables[name].definition
        self._alter(name, d.columns, self.read(name).orderBy(*order))

    # -- triggers, snapshots, transactions ------------------------------------------------------------------------
    def trigger(self, name: str, when: str, change: Callable[[DataFrame], DataFrame | None]) -> None:
        """A trigger as a function of a statement's rows, all at once.

        "before insert" and "before update" return the rows that are written; an update's rows also have old_<column>.
        "after insert", "after update" and "after delete" are for further changes to other tables, which stand or fall
        with the statement. Upserts and replace fire "before insert" alone, for all offered rows; update_join fires none.
        Rows that a cascade deletes fire "after delete"; references that are set to null fire none.
        """
        if when.lower() not in WHEN:
            raise ValueError(f"a trigger is one of {', '.join(WHEN)}")
        self.triggers.setdefault((name, when.lower()), []).append(change)

    def _fires(self, name: str, event: str) -> bool:
        return any(self.triggers.get((name, f"{when} {event}")) for when in ("before", "after"))

    def _after(self, name: str, event: str, rows: DataFrame | None) -> None:
        for f in self.triggers.get((name, f"after {event}"), []):
            f(rows)

    @contextmanager
    def _whole(self) -> Iterator[None]:
        """If any of the changes within fails, all tables stay as they were."""
        state = self._state()
        try:
            yield
        except Exception:
            self.tables = state
            raise

    def _state(self) -> dict:
        return {n: replace_table(t) for n, t in self.tables.items()}

    def snapshot(self, name: str) -> None:
        self.snapshots[name] = self._state()

    def restore(self, name: str) -> None:
        self.tables = {n: replace_table(t) for n, t in self.snapshots[name].items()}

    def drop_snapshot(self, name: str) -> None:
        del self.snapshots[name]

    def begin(self) -> None:
        self._open = [("", self._state())]

    def savepoint(self, name: str) -> None:
        self._open = [x for x in self._open if x[0] != name] + [(name, self._state())]

    def rollback(self, to: str = "") -> None:
        at = next(i for i, x in enumerate(self._open) if x[0] == to)
        self.tables = {n: replace_table(t) for n, t in self._open[at][1].items()}
        self._open = self._open[: at + 1] if to else []

    def release(self, name: str) -> None:
        self._open = self._open[: next(i for i, x in enumerate(self._open) if x[0] == name)]

    def commit(self) -> None:
        self._open = []

    # -- catalog --------------------------------------------------------------------------------------------------
    def information_schema(self, what: str) -> DataFrame:
        """tables, columns or views as a DataFrame."""
        if what == "tables":
            return self.spark.createDataFrame([(n, "BASE TABLE", t.version) for n, t in self.tables.items()] + [(n, "VIEW", None) for n in self.views], "table_name string, table_type string, version int")
        if what == "columns":
            rows = [(n, c.name, i, c.type, "NO" if not c.nullable or c.name in t.definition.primary_key else "YES", "PRI" if c.name in t.definition.primary_key else "UNI" if (c.name,) in t.definition.unique else "") for n, t in self.tables.items() for i, c in enumerate(t.definition.columns, 1)]
            return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_key string")
        if what == "table_constraints":
            return self.spark.createDataFrame([(n, *k) for n, t in self.tables.items() for k in _constraints(t.definition)], "table_name string, constraint_name string, constraint_type string")
        if what == "key_column_usage":
            rows = [(n, label, c, i, parent, other) for n, t in self.tables.items() for label, columns, parent, others in _key_columns(t.definition) for i, (c, other) in enumerate(zip(columns, others, strict=True), 1)]
            return self.spark.createDataFrame(rows, "table_name string, constraint_name string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string")
        if what == "referential_constraints":
            rows = [(n, f"fk_{i}", k.parent, k.on_delete.upper()) for n, t in self.tables.items() for i, k in enumerate(t.definition.foreign_keys, 1)]
            return self.spark.createDataFrame(rows, "table_name string, constraint_name string, referenced_table_name string, delete_rule string")
        if what == "triggers":
            return self.spark.createDataFrame([(n, when) for (n, when), all_ in self.triggers.items() for _ in all_], "table_name string, event string")
        if what != "views":
            raise KeyError(what)
        return self.spark.createDataFrame(list(self.views.items()), "table_name string, view_definition string")

    def show_tables(self, pattern: str = "%") -> DataFrame:
        """SHOW FULL TABLES LIKE pattern."""
        return self.information_schema("tables").filter(F.col("table_name").ilike(pattern)).select("table_name", "table_type")

    def show_index(self, name: str) -> DataFrame:
        """SHOW INDEX: the columns of the primary and unique keys."""
        keys = self.information_schema("key_column_usage").filter((F.col("table_name") == name) & F.col("referenced_table_name").isNull())
        return keys.select("table_name", F.col("constraint_name").alias("key_name"), F.col("ordinal_position").alias("seq_in_index"), "column_name")

    def show_create(self, name: str) -> str:
        """SHOW CREATE TABLE, or VIEW."""
        if name in self.views:
            return f"CREATE VIEW `{name}` AS {self.views[name]}"
        d = self.tables[name].definition
        quoted = lambda columns: ", ".join(f"`{c}`" for c in columns)
        lines = [f"`{c.name}` {c.type}" + ("" if c.nullable else " NOT NULL") + (" AUTO_INCREMENT" if c.auto_increment else "") + (f" GENERATED ALWAYS AS ({c.generated})" if c.generated else "") for c in d.columns]
        lines += [f"PRIMARY KEY ({quoted(d.primary_key)})"] if d.primary_key else []
        lines += [f"UNIQUE KEY ({quoted(k)})" for k in d.unique] + [f"CHECK ({x})" for x in d.checks]
        lines += [f"FOREIGN KEY ({quoted(k.columns)}) REFERENCES `{k.parent}` ({quoted(k.parent_columns)}) ON DELETE {k.on_delete.upper()}" for k in d.foreign_keys]
        return f"CREATE TABLE `{name}` (\n  " + ",\n  ".join(lines) + "\n)"

    def checksum(self, *names: str) -> DataFrame:
        """CHECKSUM TABLE: the sum of the rows' CRC-32 of their JSON, whatever their order; NULL for no such table."""
        out = None
        for n in names:
            if n in self.tables:
                row = F.crc32(F.to_json(F.struct(*self.read(n).columns), {"ignoreNullFields": "false"}).cast("binary"))
                one = self.read(n).agg(F.coalesce(F.sum(row), F.lit(0)).alias("checksum")).select(F.lit(n).alias("table_name"), "checksum")
            else:
                one = self.spark.range(1).select(F.lit(n).alias("table_name"), F.lit(None).cast("long").alias("checksum"))
            out = one if out is None else out.unionByName(one)
        return out

    def describe(self, name: str) -> DataFrame:
        return self.information_schema("columns").filter(F.col("table_name") == name).orderBy("ordinal_position")


def _key_columns(d: TableDef) -> list[tuple]:
    """Name, columns, and for foreign keys the parent and its columns."""
    found = [("PRIMARY", d.primary_key, None, (None,) * len(d.primary_key))] if d.primary_key else []
    found += [(f"unique_{i}", k, None, (None,) * len(k)) for i, k in enumerate(d.unique, 1)]
    return found + [(f"fk_{i}", k.columns, k.parent, k.parent_columns) for i, k in enumerate(d.foreign_keys, 1)]


def _constraints(d: TableDef) -> list[tuple[str, str]]:
    kinds = [(label, "PRIMARY KEY" if label == "PRIMARY" else "FOREIGN KEY" if parent else "UNIQUE") for label, _, parent, _ in _key_columns(d)]
    return kinds + [(f"check_{i}", "CHECK") for i, _ in enumerate(d.checks, 1)]


def numbered(df: DataFrame, name: str, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with a column of row numbers from 0 in its order, without gathering rows: places in partitions and their sizes.

    The places are staged before the sizes are counted: another evaluation may deal the rows otherwise.
    """
    df = stage(df.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = df.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row for each partition
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r.p, at))
        at += r["count"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _at long")
    return df.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_at") + F.col(name).bitwiseAND(F.lit(2**33 - 1))).drop("_p", "_at")


def replace_table(t: _Table) -> _Table:
    return _Table(t.definition, t.version, t.next_id)
