"""Packing documents into sequences by column generation for the cutting-stock problem.

Documents are cut into full sequences, at most one half and one quarter of a sequence, and a rest below a quarter:
whole rests of up to a sequence would leave 9 % padding on the test documents however they are combined, these leave
a few tenths of a per cent. The lengths of all pieces give a histogram (at most one bin per
length, whatever the size of the data). A linear program over patterns (how many pieces of each length share a
sequence) is solved on the driver by the revised simplex method; a knapsack dynamic program over its dual prices
finds the next pattern to add. The patterns' counts are rounded down, and what is left over is filled greedily. Then
each length's pieces are ranked and the ranks are dealt to the patterns' places, all in parallel.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Workspace, with_place

#: Tokens of a sequence; the id that ends each document.
CAPACITY, END_ID = 1024, 0
#: The linear program ends when its cost is within this share of a lower bound, or after so many pivots.
GAP, PIVOTS = 0.001, 4000
#: Patterns that one knapsack adds at most.
COLUMNS = 40
#: Buckets that the pieces of one length are ranked in at least; pieces of a bucket on the average at most.
BUCKETS, BUCKET_ROWS = 256, 200_000
# Fixed value: the split pattern of byte-level BPE (public, as of the tokenizer file's pre-tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level BPE files: a byte's own where it is printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_encoding(data: bytes) -> tiktoken.Encoding:
    """An encoding from a tokenizer JSON of byte-level BPE, with its added tokens as special ones."""
    spec = json.loads(data)
    names = byte_names()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(names.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("tokenizer", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


_encodings: dict[int, tiktoken.Encoding] = {}


def cut(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise each text (null: empty), add the end id, cut: doc_id, start, length, ids_crc32, doc_tokens by piece.

    Rows are independent: repeated rows and null or repeated ids give pieces each, a very long text gives as many as it
    needs, an empty table none; columns other than the two named are not read.
    """
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()
    parts = [part for part in (capacity, capacity // 2, capacity // 4) if part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value)
        encoding = _encodings.get(key) or _encodings.setdefault(key, load_encoding(shared.value))
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encoding.encode(text, allowed_special="all"), END_ID], "<u4")
                s = 0
                while s < len(ids):
                    left = len(ids) - s
                    piece = ids[s : s + next((part for part in parts if part <= left), left)]
                    at.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    s += len(piece)
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    pairs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return pairs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int, wanted: int = 1) -> tuple[float, list[np.ndarray]]:
    """The best value of a pattern within the capacity, and up to `wanted` valuable patterns (counts by size).

    Dynamic programming over filled lengths; the patterns are the best that hold a given size, for the sizes whose
    best pattern is worth most.
    """
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := upto[w]:
            value = best[w - sizes[:k]] + prices[:k]
            i = int(value.argmax())
            if value[i] > best[w] + 1e-12:
                best[w], took[w] = value[i], i
    worth = prices + best[capacity - sizes]
    patterns = []
    for i in np.argsort(-worth, kind="stable")[:wanted].tolist():
        pattern, w = np.zeros(len(sizes), np.int64), capacity - int(sizes[i])
        pattern[i] = 1
        while w > 0:
            if took[w] < 0:
                w -= 1
            else:
                pattern[took[w]] += 1
                w -= int(sizes[took[w]])
        patterns.append(pattern)
    return float(best[capacity]), patterns


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program's (near-)optimal basis."""
    start = capacity // sizes
    columns, inverse = np.diag(start).astype(float), np.diag(1.0 / start)
    used, done = inverse @ demand, 0
    while done < pivots:
        prices = np.maximum(inverse.sum(axis=0), 0)  # every sequence costs 1
        value, patterns = knapsack(sizes, prices, capacity, COLUMNS)
        cost = used.sum()
        if value <= 1 + 1e-9 or cost - prices @ demand / value <= gap * cost:  # the bound scales the prices to a feasible dual
            break
        prices = inverse.sum(axis=0)
        for pattern in patterns:
            if prices @ pattern <= 1 + 1e-7:
                continue
            has = np.flatnonzero(pattern)
            step = inverse[:, has] @ pattern[has]
            ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
            out = int(ratio.argmin())
            used -= ratio[out] * step
            used[out] = ratio[out]
            np.maximum(used, 0, out=used)
            row = inverse[out] / step[out]
            gain = step.sum() - step[out]
            inverse -= np.multiply.outer(step, row)
            inverse[out] = row
            prices = prices - (gain + step[out] - 1) * row
            columns[:, out] = pattern
            done += 1
    return columns.astype(np.int64), used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(count, {length: pieces}) by pattern, so that every piece of the histogram has exactly one place."""
    sizes = np.array(sorted(s for s in histogram if s < capacity), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    out = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    if not len(sizes):
        return out
    columns, used = solve(sizes, left.astype(float), capacity)
    order = np.argsort(-(sizes @ columns), kind="stable")
    for j in order.tolist():  # the fullest first; never more than there is
        pattern = columns[:, j]
        has = pattern > 0
        times = min(int(used[j] + 1e-6), int((left[has] // pattern[has]).min()))
        if times > 0:
            left = left - times * pattern
            out.append((times, {int(s): int(n) for s, n in zip(sizes[has], pattern[has], strict=True)}))
    while left.any():  # the largest that fit, again and again
        room, pattern = capacity, {}
        for i in np.flatnonzero(left)[::-1].tolist():
            if (n := min(int(left[i]), room // int(sizes[i]))) > 0:
                pattern[int(sizes[i])] = n
                room -= n * int(sizes[i])
        times = min(int(left[np.searchsorted(sizes, s)]) // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[np.searchsorted(sizes, s)] -= times * n
        out.append((times, pattern))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, sequences, first sequence, offset): a place of a pattern takes a run of ranks."""
    rows, rank, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            for _ in range(pattern[size]):
                rows.append((size, rank.get(size, 0), sequence, offset))
                rank[size] = rank.get(size, 0) + times
                offset += size
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 44 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (doc_id, start, length of 1 to capacity, others) a sequence_id and an offset there.

    Ranks within a length are counted in buckets of the pieces' places, as many as the table needs, so that a length
    with most of the pieces is ranked by many tasks. Repeated rows and null ids are pieces like any other; no pieces
    give an empty result.
    """
    ws = Workspace(pieces.sparkSession, "packing")
    names = pieces.columns
    pieces = with_place(ws.stage(pieces, "pieces"), ws)
    buckets = max(BUCKETS, pieces.count() // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("__place"), F.lit(buckets)).cast("int"))
    counts = ws.stage(pieces.groupBy("length", "bucket").count(), "counts")  # at most capacity x buckets rows
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("__place"))
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        key = length.to_numpy() << 44 | rank.to_numpy()
        at = np.searchsorted(table["key"], key, side="right") - 1
        return pd.DataFrame({"sequence_id": table["sequence"][at] + rank.to_numpy() - table["rank"][at], "offset": table["offset"][at]})

    return ranked.withColumn("__at", place("length", "rank")).select(*names, "__at.sequence_id", "__at.offset")
