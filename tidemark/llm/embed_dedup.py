"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes (fitted on a bounded sample; a rotation keeps every cosine, so the
sample affects speed alone). A k-d split along the leading axes deals them to cells and tiles of bounded size, which
are files in the shared folder. Two cells are compared unless their boxes are farther apart than the threshold
allows. Within a pair of tiles the leading dimensions are accumulated first; the rest of each product is bounded by
the product of the suffix norms, and pairs whose bound is below the threshold are dropped, until none is left or all
dimensions are in. Equal vectors are one class and are compared once. A pair of tiles gives the number of links by
vector and a spanning forest of them, never the links themselves, so a large group of near copies stays linear.

Every vector is compared, none is sampled or capped; every pair of cosine >= threshold is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, join_spread
from tidemark.llm.components import connected_components

#: Vectors that the axes and the split are fitted on; vectors of a tile; leading axes of the boxes; levels of the split (4096 cells at most).
SAMPLE, TILE, LEAD, LEVELS = 4096, 2048, 8, 12
#: Cosines this near to the threshold are computed once more from the vectors as given.
NEAR = 1e-9
TILE_SCHEMA = "cell int, sub int, node long, size long, turned binary, given binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # against overflow of the squares
    vectors = vectors / np.where(scale > 0, scale, 1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def as_matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Split:
    """Principal axes, and a k-d split of the leading ones as a complete binary tree of (axis, limit)."""

    def __init__(self, sample: np.ndarray, levels: int):
        width = sample.shape[1]
        _, axes = np.linalg.eigh(sample.T @ sample) if len(sample) else (None, np.eye(width))
        self.axes = axes[:, ::-1].copy()
        self.levels = levels
        self.axis, self.limit = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
        lead = (sample @ self.axes)[:, :LEAD]
        self._fit(0, 0, lead)

    def _fit(self, node: int, level: int, rows: np.ndarray) -> None:
        if level == self.levels:
            return
        if len(rows):
            self.axis[node] = int(rows.var(axis=0).argmax())
            self.limit[node] = np.median(rows[:, self.axis[node]])
        right = rows[:, self.axis[node]] > self.limit[node] if len(rows) else np.zeros(0, bool)
        self._fit(2 * node + 1, level + 1, rows[~right])
        self._fit(2 * node + 2, level + 1, rows[right])

    def cells(self, turned: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(turned), np.int64), np.arange(len(turned))
        for _ in range(self.levels):
            node = 2 * node + 1 + (turned[rows, self.axis[node]] > self.limit[node])
        return node - (2**self.levels - 1)


def box_gap(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared distances between boxes (last axis: dimensions)."""
    return (np.maximum(0, np.maximum(lo - other_hi, other_lo - hi)) ** 2).sum(axis=-1)


class Tile:
    def __init__(self, node: np.ndarray, size: np.ndarray, turned: np.ndarray, read_given: Callable[[], np.ndarray]):
        self.node, self.size, self.turned, self._given, self._read = node, size, turned, None, read_given
        squares = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate((squares, np.zeros((len(turned), 1))), axis=1))
        self.lo, self.hi = turned[:, :LEAD].min(axis=0), turned[:, :LEAD].max(axis=0)

    @property
    def given(self) -> np.ndarray:
        """The vectors as they came; read only where a cosine is near the threshold."""
        if self._given is None:
            self._given = self._read()
        return self._given


@lru_cache(maxsize=6)
def load_tile(path: str) -> Tile:
    system, where = fs.FileSystem.from_uri(path)
    files = [f for f in system.get_file_info(fs.FileSelector(where)) if f.base_name.startswith("part-")]

    def read(*columns: str) -> pa.Table:
        return pa.concat_tables([pq.read_table(f.path, filesystem=system, columns=list(columns), partitioning=None) for f in files])

    def matrix(t: pa.Table, column: str) -> np.ndarray:
        return np.frombuffer(b"".join(t[column].to_pylist()), np.float64).reshape(t.num_rows, -1)

    t = read("node", "size", "turned")
    return Tile(t["node"].to_numpy(), t["size"].to_numpy(), matrix(t, "turned"), lambda: matrix(read("given"), "given"))


def linked(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of all pairs whose cosine reaches the threshold; of one tile, both ways without i = j."""
    none = np.zeros(0, np.int64)
    width = a.turned.shape[1]
    if box_gap(a.lo, a.hi, b.lo, b.hi) > 2 - 2 * threshold + NEAR:
        return none, none
    product, done = np.zeros((len(a.node), len(b.node))), 0
    while done < width:
        upto = min(width, max(LEAD, width // 4, 2 * done))
        product += a.turned[:, done:upto] @ b.turned[:, done:upto].T
        done = upto
        alive = product + np.multiply.outer(a.suffix[:, done], b.suffix[:, done]) >= threshold - NEAR
        n = int(alive.sum())
        if not n:
            return none, none
        if n < product.size // 16 or done == width:
            break
    i, j = np.nonzero(alive)
    if same:
        i, j = i[i != j], j[i != j]
    value = product[i, j]
    while done < width and len(i):  # the few pairs that are left, one by one
        upto = min(width, 2 * done)
        value = value + np.concatenate([np.einsum("kd,kd->k", a.turned[i[s : s + 65536], done:upto], b.turned[j[s : s + 65536], done:upto]) for s in range(0, len(i), 65536)])
        done = upto
        keep = value + a.suffix[i, done] * b.suffix[j, done] >= threshold - NEAR
        i, j, value = i[keep], j[keep], value[keep]
    close = np.flatnonzero(np.abs(value - threshold) <= NEAR)
    for k in close.tolist():
        x, y = a.given[i[k]], b.given[j[k]]
        value[k] = x @ y / np.sqrt((x @ x) * (y @ y))
    keep = value >= threshold
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Each linked vector with the least vector that it reaches within the pair of tiles."""
    nodes, at = np.unique(np.concatenate((a.node[i], b.node[j])), return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of df: the id, n_links, component_id (least id reachable by links), kept (id = component_id).

    Two vectors link when their cosine (double precision) is at least the threshold (above 0). Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; shorter vectors count as filled up with
    zeros. Rows that repeat an id are vectors of their own that share the id. A null id is never a component's least
    unless all are null. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "embeddings")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    classes = rows.filter(sound).groupBy("v").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    classes = ws.stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if n:
        levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n / tile))))))
        picked = classes.orderBy(F.xxhash64("v"), "node").limit(sample).select("v").collect()
        split = Split(unit(as_matrix([r.v for r in picked], width)), levels)
        links, edges = _compare(classes, split, width, threshold, tile, ws)
        component = connected_components(edges, ws)
        least = component.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
        found = classes.join(links, "node", "left").join(component.join(least, "component"), "node", "left")
        found = ws.stage(found.select("v", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "found")
    else:
        found = classes.select("v", "size", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    out = join_spread(rows.filter(sound), found, ["v"], "size", rows.count(), F.col("id")).select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(rows.filter(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _compare(classes: DataFrame, split: Split, width: int, threshold: float, tile: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = as_matrix(batch.column(2).to_pylist(), width)
            turned = unit(given) @ split.axes
            lead = pa.array(turned[:, :LEAD].tolist(), pa.list_(pa.float64()))
            matrices = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (turned, given)]
            yield pa.RecordBatch.from_arrays([pa.array(split.cells(turned), pa.int32()), batch.column(0), batch.column(1), *matrices, lead], names=["cell", "node", "size", "turned", "given", "lead"])

    dealt = ws.stage(classes.select("node", "size", "v").mapInArrow(deal, "cell int, node long, size long, turned binary, given binary, lead array<double>"), "dealt")
    dims = min(LEAD, width)
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("lead")[d]).alias(f"{name}{d}") for d in range(dims) for name, f in (("lo", F.min), ("hi", F.max)))).orderBy("cell").collect()  # at most 2 ** LEVELS rows
    subs = {r.cell: -(-r.n // tile) for r in boxes}
    lo, hi = (np.array([[r[f"{name}{d}"] for d in range(dims)] for r in boxes]) for name in ("lo", "hi"))
    cell, tiles_of = np.array([r.cell for r in boxes], np.int32), np.array([subs[r.cell] for r in boxes], np.int32)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells from each given one (by its place among the boxes) on whose box is near enough."""
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = np.flatnonzero(box_gap(lo[k], hi[k], lo[k:], hi[k:]) <= 2 - 2 * threshold + NEAR) + k
                one = np.ones(len(found), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one * cell[k], one * tiles_of[k], cell[found], tiles_of[found])], names=["a", "na", "b", "nb"])

    pairs = spark.range(len(boxes)).repartition(max(1, len(boxes) // 64)).mapInArrow(near, "a int, na int, b int, nb int")
    of = spark.createDataFrame([(c, s) for c, s in subs.items()], "cell int, subs int")
    tiles = dealt.join(F.broadcast(of), "cell").withColumn("sub", F.pmod(F.xxhash64("node"), "subs").cast("int")).drop("lead", "subs")
    tiles.repartition("cell", "sub").write.partitionBy("cell", "sub").parquet(f"{ws.path}/tiles")
    root = f"{ws.path}/tiles"
    # Of one cell, each pair of its tiles once.
    work = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).filter("a < b or i <= j")
    there = tiles.select("cell", "sub").distinct()  # hashing may leave a tile without vectors
    for cell, sub in (("a", "i"), ("b", "j")):
        work = work.join(there.toDF(cell, sub), [cell, sub], "left_semi")
    parts = max(1, min(sum(subs.values()) * 2, 4096))
    work = work.select("a", "i", "b", "j").repartition(parts, "a", "i", "b", "j").sortWithinPartitions("a", "i", "b", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ca, i, cb, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = load_tile(f"{root}/cell={ca}/sub={i}"), load_tile(f"{root}/cell={cb}/sub={j}")
                same = (ca, i) == (cb, j)
                u, v = linked(a, b, threshold, same)
                if not len(u):
                    continue
                of_a = np.bincount(u, weights=b.size[v], minlength=len(a.node)).astype(np.int64)
                of_b = np.zeros(0, np.int64) if same else np.bincount(v, weights=a.size[u], minlength=len(b.node)).astype(np.int64)
                node, links = np.concatenate((a.node, b.node[: len(of_b)])), np.concatenate((of_a, of_b))
                node, links = node[links > 0], links[links > 0]
                x, y = forest(u, v, a, b)
                columns = (np.concatenate((node, x)), np.concatenate((links, y)), np.arange(len(node) + len(x)) >= len(node))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "edge"])

    out = ws.stage(work.mapInArrow(compare, "a long, b long, edge boolean"), "links")
    links = out.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    return links, out.filter("edge and a <> b").select("a", "b")
