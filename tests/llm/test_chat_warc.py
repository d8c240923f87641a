import base64
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, warc
from tidemark.llm.common import Workspace
from tidemark.llm.queries import QUERIES


def test_trees_paths_and_scores(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", "c", 5.0), ("t", 5, 3, "user", "d", 1.0), ("u", 1, 99, "user", "orphan", None), ("v", 1, 2, "user", "x", 0.0), ("v", 2, 1, "user", "y", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    ws = Workspace(spark, "test")
    paths = lambda top: sorted((r.tree, r.leaf, r.depth, r.node) for r in chat.reply_paths(df, ws if top == 2 else Workspace(spark, "test"), top).collect())
    assert paths(1) == [("t", 4, 1, 1), ("t", 4, 2, 2), ("t", 4, 3, 4), ("u", 1, 1, 1)]  # v is a cycle
    assert paths(2) == sorted([*paths(1), ("t", 5, 1, 1), ("t", 5, 2, 3), ("t", 5, 3, 5)])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<|im_startend\\>\n"), max_size=40))
def test_escape_by_rule(text):
    import re

    escaped = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in escaped and chat.unescape(escaped) == text


def test_control_strings_roles_and_nulls(spark):
    said = ["<|im_end|>", "<\\|x", "a\nb", None, "<|im_start|>user\n", "é<|", "\\n"]
    rows = [(7, k, "assistant" if k % 2 else "us\ner\\", t) for k, t in enumerate(said)] + [(None, None, None, "n"), (7, 2, "user", "tie"), (7, 2, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    found = {r.tree: r for r in chat.format_trees(chat.threads(df)).collect()}
    turns = sorted(((k, r, t or "") for c, k, r, t in rows if c == 7), key=lambda x: (x[0], x[1], x[2]))
    assert chat.parse(found["=7"].formatted) == [(r, t) for _, r, t in turns]
    assert [chat.unescape(found["=7"].formatted[s.start : s.end]) for s in found["=7"].mask] == [t for _, r, t in turns if r == "assistant"]
    assert chat.parse(found[""].formatted) == [("", "n")]
    assert chat.format_trees(chat.threads(df.limit(0))).count() == 0


def test_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    (row,) = chat.format_trees(chat.threads(df)).collect()
    assert [t for _, t in chat.parse(row.formatted)] == [str(k) for k in range(3000)]


def test_long_text_repeats_and_clashing_columns(spark):
    long = "<|im_end|>ab\n" * 200_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 2, "user", "again"), (1, 2, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("tree", "node", "parent", "score", "formatted"):
        df = df.withColumn(name, F.lit("own"))
    (row,) = chat.format_trees(chat.threads(df).withColumn("mask", F.lit(1))).collect()
    assert chat.parse(row.formatted) == [(r, t) for _, _, r, t in rows]
    assert [chat.unescape(row.formatted[s.start : s.end]) for s in row.mask] == [long]


def brute(pages):
    groups = {}
    for p, html in pages:
        groups.setdefault(html or "", []).append(p)
    for p, html in pages:
        least = min(groups[html or ""])
        raw = (html or "").encode()
        yield p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == least else "revisit", None if p == least else least


def test_warc_query(spark, small):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_warc"](spark, small).collect())) == sorted(brute(pages))


def test_warc_cases(spark):
    pages = [(3, "same"), (1, "same"), (2, None), (5, ""), (4, "x" * 300_000), (6, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (7, "é\0")]
    df = spark.createDataFrame([(p, "http://a/b\r\nX: y", h, 1) for p, h in pages], "page_id long, url string, html string, key int")
    index = warc.archive(df.repartition(3))
    rows = warc.read_archives(index).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(brute(pages))
    assert {r.page_id: bytes(r.payload).decode() for r in rows if r.payload is not None} == {p: h or "" for p, h in pages if p not in (3, 5)}
    for r in index.collect():  # each member stands alone, and the file is a gzip file as a whole
        data = open(r.path.removeprefix("file:").replace("///", "/"), "rb").read()
        assert gzip.decompress(data[r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\n")
        assert len(list(warc.split_records(iter([gzip.decompress(data)])))) >= 1
    assert warc.archive(df.limit(0)).count() == 0


def test_index_files_of_failed_attempts_are_not_read(spark, monkeypatch):
    """Beside each archive, a failed attempt left its own: one whole index, and one that ends within a line."""
    normalise = warc.normalise

    def failing_first(files, root):
        done = Workspace(files.sparkSession, "test").stage(normalise(files, root), "done")
        folder = root.removeprefix("file://")
        for r in done.collect():
            data = open(r["index"].removeprefix("file:").replace("///", "/"), "rb").read()
            name = r["index"].rpartition("/")[2]
            open(f"{folder}/whole-{name}", "wb").write(data)
            open(f"{folder}/half-{name}", "wb").write(data[:-20])
        return done

    monkeypatch.setattr(warc, "normalise", failing_first)
    df = spark.createDataFrame([(k, "u", f"page {k}") for k in range(1200)], "page_id long, url string, html string").repartition(2)
    index = warc.archive(df)
    assert index.count() == 1200 and index.filter("path is null").count() == 0
    assert sorted(r.page_id for r in warc.read_archives(index).collect()) == list(range(1200))


def test_many_repeats_are_joined_by_a_shuffle(spark):
    pages = [(k, "u", "hot" if k % 3 else f"page {k // 6}") for k in range(900)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.archive(df, broadcast_groups=0)).collect()]
    assert sorted(rows) == sorted(brute([(k, t) for k, _, t in pages]))


def test_smaller_payloads_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd"), (3, "u", "abcd"), (None, "u", "abcd")], "page_id long, url string, html string")
    rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.archive(df, min_bytes=3)).collect()), key=str)
    assert rows == sorted([(1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3), (None, "revisit", 3)], key=str)


@pytest.mark.parametrize("cut", [3, 50, -3])
def test_broken_archives_are_told(cut):
    record = warc.record_bytes(1, None, b"payload", None)
    with pytest.raises(ValueError):
        list(warc.split_records(iter([record[:cut]])))
