"""What the operators share: the folder all executors see, staged tables, Arrow batch bounds, workers' memory."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: what a Python worker holds of the table at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: A key is split in a join if it has more rows than both: so many, and this share of all (so at most 1 / HOT_SHARE keys are).
HOT_ROWS, HOT_SHARE = 200, 1e-5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts don't pile up in one.

    The session's options are lowered, never raised, and stay so: Spark reads them when the result is computed.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return this process's free memory to the system: a Python worker keeps it else, also while it waits for tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and the master is local (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


class Workspace:
    """Tables of one run of an operator, written below the shared folder.

    A staged table cuts the lineage with a write that every executor can read, so the loss of an executor costs
    only the tasks that it was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps that are staged; else they stay until the driver's next full collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self) -> None:
        """Delete the workspace; results that read it are gone then. Runs when the driver's Python ends, if Spark still is there."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
                self.drop("")

    def drop(self, name: str) -> None:
        """Delete a staged table (or a folder of this workspace) that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds = 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], size: str, n: int, by: Column, how: str = "inner") -> DataFrame:
    """rows joined to table (one row per key; column `size`: the key's rows), with the rows of hot keys split over parts.

    n is the number of rows. Keys with more than HOT_SHARE of them, 1 / HOT_SHARE at most, are broadcast to tell each
    row of theirs its part, by the hash of `by`; their row of the table is repeated once a part. table is read twice.
    """
    most = max(HOT_ROWS, int(n * HOT_SHARE))
    parts = F.ceil(F.col(size) / most).cast("int")
    hot = table.filter(F.col(size) > most).select(*(F.col(c).alias(f"__{c}") for c in on), parts.alias("__parts"))
    same = [rows[c].eqNullSafe(hot[f"__{c}"]) for c in on]
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), "__parts")).cast("int")).drop("__parts", *(f"__{c}" for c in on))
    spread = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, parts - 1).otherwise(0))))
    return dealt.join(spread, [*on, "__part"], how).drop("__part")


def with_place(df: DataFrame, ws: Workspace, name: str = "__place") -> DataFrame:
    """df with a column that tells its rows apart, repeated ones too: the row's file and place in it, the same at every reading.

    A table that isn't read from files is staged first.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(name, place)
    except AnalysisException:
        return ws.stage(df, "rows").withColumn(name, place)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
