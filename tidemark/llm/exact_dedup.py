"""Exact dedup by progressive refinement, in DataFrame operations only.

Groups are refined step by step: by length, then by the hash of a prefix, then by the full hash, and the full
content is compared only for the groups that are left. A step shuffles only rows (of hashes, never texts) whose
group had at least two rows in the step before. Group sizes come from aggregations that combine before the shuffle,
and rows meet their group in joins that split the hot groups: a group (or a length) with a third of all rows is never
gathered in one task.

The SHA-256 of every text is part of the result, so every text is read and hashed once in any case; what refinement
saves is the second reading, the comparison of contents, which only the groups that are left need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, join_spread

#: Characters of the prefix that is hashed in the second step.
PREFIX = 256
#: Groups whose keys (8 bytes each) are broadcast to pick the rows whose content is compared; more are joined by a shuffle.
BROADCAST_GROUPS = 2_000_000
#: Parts that each group is split into in that shuffle.
SALTS = 16


def normalised(text: Column) -> Column:
    """Null as empty, and each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", full_hash=sha256, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """One row per row of df: the id, keep_id (smallest id of the equal texts), group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; a null text counts as empty, so nulls and empty texts form one
    group. A null id sorts after every other: it is kept only in a group without other ids. Rows that repeat an id
    are rows of their group like any other; where they repeat the kept id, exactly one of them is kept. An empty
    table gives an empty result; columns other than the two named are not read.
    full_hash may be weak: equal hashes of unequal texts are told apart by content.
    """
    ws = Workspace(df.sparkSession, "exact-dedup")
    source = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text")).withColumns({"length": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, PREFIX)), "full": full_hash(F.col("text"))})
    hashed = ws.stage(source.select("id", "length", "prefix", "full", sha256(F.col("text")).alias("sha"), F.monotonically_increasing_id().alias("row")), "hashed")

    n, left, key = hashed.count(), hashed, []
    for step in ("length", "prefix", "full"):
        key.append(step)
        groups = ws.stage(left.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1"), f"groups-{step}")
        if step != "full":
            left = join_spread(left, groups, key, "rows", n, F.col("row"), "left_semi")
    groups = groups.drop("rows")

    # The content of the groups that are left, each text once for each task that has it.
    if groups.count() <= broadcast_groups:
        keys = groups.select(F.xxhash64(*key).alias("key")).distinct()
        survivors = source.join(F.broadcast(keys), F.xxhash64(*key) == F.col("key"), "left_semi")
    else:
        keys = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        survivors = source.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(keys.hint("shuffle_hash"), [*key, "salt"], "left_semi")
    contents = survivors.groupBy(*key, "text").agg(F.lit(1).alias("one")).groupBy(*key, sha256(F.col("text")).alias("sha")).count()
    compared = contents.select(*key, "sha", F.when(F.col("count") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("unequal texts have one SHA-256"))).alias("equal"))

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = left.groupBy(*key, "sha").agg(F.count("*").alias("size"), first.alias("first")).filter("size > 1").join(compared, [*key, "sha"]).filter("equal").drop("equal")
    rows = join_spread(hashed, ws.stage(classes, "classes"), [*key, "sha"], "size", n, F.col("row"), "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
