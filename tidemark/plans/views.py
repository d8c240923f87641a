"""SQL over the Parquet tables below a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_sql(spark: SparkSession, sf_dir: str, text: str, **parameters) -> DataFrame:
    """Run SQL whose table names stand for the Parquet tables; only those that the text names are read.

    The tables are passed as arguments of the statement, not registered: nothing is left in the session's catalog, and
    Catalyst sees plain scans.
    """
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    for name in used:
        text = re.sub(rf"(?<![\w.{{'])\b{name}\b(?!\s*\(|\s*\.\s*\w|')", f"{{{name}}}", text)
    return spark.sql(text, args=parameters or None, **used)
