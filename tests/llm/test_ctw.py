import math
import zlib
from collections import Counter
from fractions import Fraction
from math import lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ctw
from tidemark.llm.queries import QUERIES

DOCS = [(1, "The cat sat.\tThe cat", True), (2, "the dog sat", True), (3, "a cat", False), (4, None, True), (5, "", False), (6, "zebra é\x00", False), (7, "the cat sat. the cat", True)]


def brute(docs):
    """The definitions, one bit at a time, with plain recursion over a dictionary of nodes."""
    text = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t, _ in docs}
    counts: dict = {}
    for i, _, learn in docs:
        data = b"\n" * ctw.DEPTH + text[i]
        for at in range(ctw.DEPTH, len(data)) if learn else ():
            for j in range(8):
                node = 1 << j | data[at] >> (8 - j)
                for d in range(ctw.DEPTH + 1):
                    counts.setdefault((node, data[at - d : at]), [0, 0])[data[at] >> (7 - j) & 1] += 1
    children: dict = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[1:]), []).append((node, context))

    def own(key):
        a, b = counts[key]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key):
        if len(key[1]) == ctw.DEPTH:
            return own(key)
        return np.logaddexp(math.log(0.5) + own(key), math.log(0.5) + sum(map(weighted, children[key])))

    def p(node, context, d, bit):
        key = (node, context[ctw.DEPTH - d :])
        a = counts.get(key, (0, 0))
        kt = (a[bit] + 0.5) / (sum(a) + 1)
        below = (node, context[ctw.DEPTH - d - 1 :]) if d < ctw.DEPTH else None
        if below not in counts:
            return kt
        share = math.exp(math.log(0.5) + own(key) - weighted(key))
        return share * kt + (1 - share) * p(node, context, d + 1, bit)

    train = Counter(w for i, t, learn in docs if learn for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    for i, t, _ in docs:
        data = b"\n" * ctw.DEPTH + text[i]
        score = sum(math.log10(p(1 << j | data[at] >> (8 - j), data[at - ctw.DEPTH : at], 0, data[at] >> (7 - j) & 1)) for at in range(ctw.DEPTH, len(data)) for j in range(8))
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        yield i, len(tokens), sum(train[w] > 0 for w in tokens), n, base, score


@pytest.mark.parametrize("chunk", [1 << 20, 10])
def test_against_the_definitions(spark, monkeypatch, chunk):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", chunk)
    df = spark.createDataFrame([(i, t, learn, "x") for i, t, learn in DOCS], "doc_id long, text string, learn boolean, score string")
    found = sorted(tuple(r) for r in ctw.score(df, F.col("learn")).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    for got, want in zip(found, brute(DOCS), strict=True):
        assert got[:4] == want[:4] and np.allclose(got[4:], want[4:], rtol=1e-9, atol=1e-9)


def test_a_distribution():
    """The 256 bytes after any context have probabilities that sum to one."""
    text = [b"the cat sat on the mat".split(), b"that cat".split()]
    code, n = np.unique(ctw.coded(text)[0], return_counts=True)
    for context in (code[3] >> 8, 0x61626364):
        every = (context << 8) | np.arange(256)
        both = np.unique(np.concatenate((code, every)))
        count = np.zeros(len(both), np.int64)
        count[np.searchsorted(both, code)] = n
        groups = {}
        import pyarrow as pa

        for g in np.unique(both >> 8 & 0xFFFF):
            at = (both >> 8 & 0xFFFF) == g
            groups[g] = pa.table({"code": both[at], "n": count[at]})
        rows = [type("R", (), dict(zip(t.column_names, v, strict=True))) for t in map(ctw.summary, groups.values()) for v in zip(*(c.to_pylist() for c in t.columns), strict=True)]
        merged: dict = {}
        for r in rows:
            m = merged.setdefault((r.c1, r.node), type("R", (), {"c1": r.c1, "node": r.node, "zeros": 0.0, "ones": 0.0, "inner": 0.0})())
            m.zeros, m.ones, m.inner = m.zeros + r.zeros, m.ones + r.ones, m.inner + r.inner
        upper = ctw.Upper(list(merged.values()))
        prices = {c: v for t in (ctw.price(g, upper) for g in groups.values()) for c, v in zip(t["code"].to_pylist(), t["value"].to_pylist(), strict=True)}
        assert abs(sum(10 ** prices[int(c)] for c in every) - 1) < 1e-9


def test_without_training_and_without_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in ctw.score(df, F.lit(None).cast("boolean")).select("doc_id", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    assert [r[:3] for r in rows] == [(1, 0, 0), (1, 0, 0), (None, 0, 0)]
    assert math.isclose(rows[0][4], -24 * math.log10(2)) and math.isclose(rows[0][3], 0, abs_tol=1e-12)
    assert ctw.score(df.limit(0), F.lit(True)).count() == 0


def test_query_beats_the_base_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_lm_score"](spark, sf)
    r = rows.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert r.n > 500 and r.s > r.b
    assert rows.filter("n_known > n_tokens or score is null or score > 0").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows.limit(500).collect())


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 10.0, 1e3, 1e9])
    assert np.allclose(ctw.log_gamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert math.isclose(math.exp(ctw.log_kt(np.array([2.0]), np.array([1.0]))[0]), Fraction(1, 2) * Fraction(3, 4) * Fraction(1, 6))
