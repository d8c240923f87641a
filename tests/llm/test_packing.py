import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers(spark, small):
    """On all documents and on texts with the special token, odd white space and other scripts."""
    t, e = Tokenizer.from_file(PATH), packing.load_encoding(open(PATH, "rb").read())
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for text in [*texts, "a<|endoftext|>b", " <|endoftext|> x", "日本語    \n\n x", "é\x00﻿", "   ", "it's they'LL 12 345"]:
        assert e.encode(text, allowed_special="all") == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("histogram", [{}, {1024: 3}, {1: 1}, {700: 5, 324: 3, 50: 9}, {int(s): int(s) % 7 + 1 for s in range(1, 257, 3)}])
def test_plan_places_every_piece_once(histogram):
    got = {}
    for times, pattern in packing.plan(dict(histogram)):
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= 1024
        for s, n in pattern.items():
            got[s] = got.get(s, 0) + n * times
    assert got == histogram


def test_linear_program_reaches_the_area_bound():
    sizes = np.array([100, 150, 200, 250, 12])
    sizes.sort()
    columns, used = packing.solve(sizes, np.full(5, 1000.0), 1000)
    assert ((columns @ used).round(6) >= 1000).all()
    assert used.sum() <= 1.01 * 1000 * sizes.sum() / 1000


def check(rows, texts):
    t = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return 1 - sum(r.length for r in rows) / (1024 * len(by_sequence))


def test_query(spark, small):
    from tidemark.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert check(QUERIES["op2_packing"](spark, small).collect(), texts) < 0.02


def test_nulls_long_texts_ties_and_none(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "the " * 5000, 3), (None, "x", 4), (5, "a b", 5), (5, "a b", 6)], "doc_id long, text string, bucket int")
    rows = packing.pack(packing.cut(df, PATH)).collect()
    t = Tokenizer.from_file(PATH)
    assert sum(r.length for r in rows) == sum(len(t.encode(r.text or "").ids) + 1 for r in df.collect())
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["1", "2", "3", "5", "5", "None"]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(packing.cut(df.limit(0), PATH)).count() == 0
