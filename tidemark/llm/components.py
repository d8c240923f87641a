"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregation (the least neighbour, combined before the shuffle) and a join back, in which the edges of
hubs are split; neighbour lists are never collected, so a hub with very many neighbours is no group in one task. Steps
are staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, join_spread


def connected_components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """edges: a, b (any order, loops and repeats allowed). Returns node, component (least node) of nodes with a link."""
    loops = edges.filter("a = b").select("a", "b")
    stars = ws.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    step, before, n = 0, None, stars.count()
    while True:
        # Large star: every neighbour above u goes to the least of u and its neighbours.
        both = stars.union(stars.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("edges"))
        large = join_spread(both, least, ["u"], "edges", 2 * n, F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges"))
        small = join_spread(large, least, ["u"], "edges", n, F.col("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        step += 1
        stars = ws.stage(small, f"{name}-{step}")
        # A star forest: no node has two parents, and no parent has one.
        state = stars.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        n = state[0]
        ws.drop(f"{name}-{step - 1}")
        if tuple(state) == before:
            break
        before = tuple(state)
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).union(loops.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
