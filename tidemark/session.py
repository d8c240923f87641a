"""Session options and table loading."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

#: Options that the engine's results depend on (zone, cast rules, recursion) or that let AQE size shuffles by data.
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
}


def build_session(name: str = "tidemark", cpus: str | int = "*", **extra: str) -> SparkSession:
    """A session with the engine's options. Under spark-submit its master, memory and partitions hold; else it is a local one."""
    builder, given = SparkSession.builder.appName(name), SparkConf()
    local = {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
    }
    for key, value in (OPTIONS | ({} if given.contains("spark.master") else local) | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir; any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
