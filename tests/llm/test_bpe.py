import hashlib
from itertools import chain

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.parse_ranks(open(PATH, "rb").read())
CODEC = bpe.MergeReplay(RANKS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab aA'\n\t", max_size=80), st.text("étion sthe<|endoftext|>", max_size=80)), max_size=5))
def test_ids_are_the_librarys(texts):
    found = list(CODEC.encode_batch(texts))
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(ids) for ids in found] == [t.encode() for t in texts]


def test_merges_that_overlap_or_come_back_sooner():
    """Ranks for which a merge makes a pair of a lower rank, so that plain rank order would differ."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aaa": 256, b"aa": 257, b"ab": 258, b"aab": 259, b"aaaa": 260}
    codec, library = bpe.MergeReplay(ranks, r"\w+"), tiktoken.Encoding("x", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for text in ("a", "aa", "aaa", "aaaa", "aaaaa", "aaaaaaa", "aab", "aaab", "abaaaab", "baaaaaaab"):
        assert list(codec.encode_batch([text])) == [library.encode_ordinary(text)]


def test_one_very_long_word():
    text = "the" * 30_000
    assert next(CODEC.encode_batch([text])) == LIBRARY.encode_ordinary(text)


def test_split_is_the_modules():
    """Every character of the first three planes in four contexts, against the regex module."""
    import regex

    found, every = bpe.splitter(PATTERN), regex.compile(PATTERN).findall
    for c in chain(range(0xD800), range(0xE000, 0x10000), range(0x10000, 0x30000, 61)):
        text = f"{chr(c)} a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}\n1{chr(c)}'s"
        assert found(text) == every(text), hex(c)


def test_small_blocks_and_a_lexicon_that_starts_anew(spark, small, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 50)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 300)
    df = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(df, PATH, PATTERN).collect()} == {i: LIBRARY.encode_ordinary(t) for i, t in texts.items()}


def test_table(spark):
    rows = [(1, "x", "a b"), (1, "y", "a b"), (None, None, "z"), (2, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = bpe.encode(df, PATH, PATTERN, digests=True)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    got = sorted(found.collect(), key=str)
    assert [(r.doc_id, r.n_tokens) for r in got if r.doc_id is None or r.doc_id == 2] == [(2, 0), (None, 0)]
    assert {r.ids_sha256 for r in got if not r.n_tokens} == {hashlib.sha256(b"").hexdigest()}
    back = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(found, PATH, PATTERN).collect()}
    assert back == {(1, b"x"), (1, b"y"), (None, b""), (2, b"")}
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("name", ["op1_byte_bpe"])
def test_query_against_the_library(spark, small, name):
    from tidemark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = QUERIES[name](spark, small).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
