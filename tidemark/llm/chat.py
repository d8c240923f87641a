"""Chat formatting of reply trees.

Iterative self-joins enumerate the paths: each round doubles the distance that a message's pointer to an ancestor
covers and sums the scores on the way, so a tree of depth d takes log2(d) rounds. The leaves' sums rank the branches
of a tree; the pointers, longest first, then give all messages of each chosen path, and each path is formatted as one
conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Workspace

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Put a backslash into each `<|` (and one more into each `<\\|`, ...): no control string is left, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reply_paths(messages: DataFrame, ws: Workspace, top: int = 1) -> DataFrame:
    """messages: tree, node, parent (null at a root), score. Returns tree, leaf, depth (from 1), node of each tree's top paths.

    A parent that isn't in the tree counts as none. Messages on a cycle have no root and are on no path. Ties of the
    summed score go to the smaller leaf. node must be unique in its tree; a null score counts as 0.
    """
    nodes = ws.stage(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    parents = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    state, jumps = ws.stage(state, "jump-0"), []
    limit = max(state.count(), 1).bit_length() + 1
    while state.filter("up is not null").limit(1).count() and len(jumps) < limit:
        jumps.append(state.filter("up is not null").select("tree", "node", "up"))
        there = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("plus"))
        ahead = state.filter("up is not null").join(there, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("plus")).alias("total"))
        state = ws.stage(state.filter("up is null").unionByName(ahead), f"jump-{len(jumps)}")
    rooted = state.filter("up is null")
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    ranked = leaves.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))).filter(F.col("place") <= top)
    path = ws.stage(ranked.select("tree", F.col("node").alias("leaf"), "node"), "path")
    for k, jump in reversed(list(enumerate(jumps))):  # staged each time, as every step reads the one before twice
        path = ws.stage(path.unionByName(path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"))), f"path-{k}")
    return path.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "depth", "node")


def format_paths(paths: DataFrame) -> DataFrame:
    """paths: tree, leaf, depth, role, text. Returns tree, leaf, formatted and mask, the loss spans of formatted.

    A conversation is one row, so its turns meet in one task; what is held there is the text of that row.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    order = Window.partitionBy("tree", "leaf").orderBy("depth")
    turns = (
        paths.select("tree", "leaf", "depth", F.concat(head, text, F.lit(f"{END}\n")).alias("turn"), F.char_length(head).alias("skip"), F.char_length(text).alias("length"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
        .withColumn("start", F.sum(F.char_length("turn").cast("long")).over(order) - F.char_length("turn") + F.col("skip"))
        .withColumn("span", F.when(F.col("learn"), F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    )
    held = F.array_sort(F.collect_list(F.struct("depth", "turn", "span")))
    return turns.groupBy("tree", "leaf").agg(held.alias("turns")).select("tree", "leaf", F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("mask"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix("\n").removesuffix(END).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text and mask alone; tree and leaf are carried."""
    kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = hashlib.sha256()
                parsed = parse(text)
                for role, said in parsed:
                    turns.update(f"{role}\n{said}\n".encode())
                learned = "".join(unescape(text[span["start"] : span["end"]]) for span in mask)
                rows.append((len(parsed), turns.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds))], names=["tree", "leaf", *(n for n, _ in kinds)])

    schema = f"tree {formatted.schema['tree'].dataType.simpleString()}, leaf {formatted.schema['leaf'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "leaf", "formatted", "mask").mapInArrow(run, schema)


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages: tree, node, parent, role, text, score; other columns are ignored. See reply_paths and format_paths.

    Null roles and texts are empty, texts count whole whatever their length, an empty table gives no rows.
    """
    ws = Workspace(messages.sparkSession, "chat")
    messages = ws.stage(messages.select("tree", "node", "parent", "role", "text", "score"), "messages")
    paths = reply_paths(messages, ws, top)
    return format_paths(paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]))


def threads(df: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as trees, each row the reply to the one before it.

    Rows go by turn, rows of one turn by role and text; null turns come first. A null conv_id is a conversation too.
    Repeated rows are turns each; columns other than the four are not read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return df.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", place.cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
