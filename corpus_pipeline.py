"""The corpus pipeline: stages of operators, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs. Rows are told apart by their place in the files, so repeated rows and repeated or null ids are
handled row by row; columns besides doc_id, text and lang are passed through unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, ngram_join, packing, quality
from tidemark.llm.common import Workspace, bound_batches, read

#: Least score of the quality classifier of documents that stay; share of a language's training documents below its least cosine.
QUALITY, BELOW = 0.3, 0.02
KEY = "__tidemark_key"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a column KEY, by which the least row of several is that of the least id (null last)."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(KEY, place)
    except AnalysisException:  # not from files
        return Workspace(docs.sparkSession, "rows").stage(docs, "docs").withColumn(KEY, place)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at QUALITY or more; it learns from all labels of docs."""
    bound_batches(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality.score(model, F.col("text")) >= QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose profile is as near a language as all but BELOW of its own documents of such a length."""
    bound_batches(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs.limit(0)
    return docs.filter(langid.known(model, langid.floors(model, docs, BELOW), F.col("text")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least id."""
    rows = keyed(docs)
    gone = exact_dedup.exact_dedup(rows, KEY).filter("not kept").select(KEY)
    return rows.join(gone, KEY, "left_anti").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word n-gram similarity of 0.8 or more connect, the one with the least id."""
    bound_batches(spark)
    rows = keyed(docs)
    gone = ngram_join.ngram_components(rows, 5, 80, 100, KEY).filter(f"{KEY} <> component_id").select(KEY)
    return rows.join(gone, KEY, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of at most 1024 tokens."""
    bound_batches(spark)
    return packing.pack(packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_classifier", quality_stage), ("language_id", language_stage), ("exact_dedup", exact_stage), ("ngram_jaccard_join", near_stage), ("packing", packing_stage)]
#: SQL can't express the classifiers; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is a table in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return docs
