"""Streaming counterparts of event queries. Event time is `ts`; late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream, with event time in the session's zone."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, root: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and read its sink back (exactly once: the sink's log holds the batches)."""
    root = root or f"file://{tempfile.gettempdir()}/tidemark-stream"
    base = f"{root}/{uuid.uuid4().hex}"
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")

    def put(batch: DataFrame, number: int) -> None:  # complete results: the last batch's folder counts
        batch.write.mode("overwrite").parquet(f"{base}/out")

    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/log").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")
