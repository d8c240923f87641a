"""Byte-level BPE encoding and decoding by merge replay.

The corpus is all documents that a worker reads, in blocks: documents are split and kept as numbers into the worker's
list of distinct words, and at a block's end the words that are new form the corpus that is replayed. An inverted
index maps each merge (by its rank) to the positions of the adjacent token pairs that it joins; merges are replayed in
rank order, and a merge updates only the index entries of its two neighbours. A word is thus encoded once a worker
however often it occurs, and the block's documents are put together by taking from the list of encodings.

No shuffle: documents are encoded where they are read, so a lost executor costs its running tasks only. (Distinct words
of the whole table, each encoded once and joined back to the blocks that have them, take more than four times the input
in shuffle files; see the README for the figures.)
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: New words and bytes of text at which a block ends; words and token pairs that a worker keeps.
BLOCK_WORDS, BLOCK_BYTES, MEMO_WORDS, MEMO_PAIRS = 100_000, 8 << 20, 800_000, 1_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A .tiktoken file: base64 of the token's bytes, then its rank, one pair per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


@cache
def _classes() -> dict[str, str]:
    """Ranges of the Basic Multilingual Plane by property, for the standard library's faster matcher."""
    plane = "".join(map(chr, (c for c in range(0x10000) if not 0xD800 <= c < 0xE000)))
    return {name: "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in _runs(name, plane)) for name in (r"\p{L}", r"\p{N}", r"\s")}


def _runs(name: str, plane: str) -> Iterator[regex.Match]:
    """Maximal runs of characters with a property; the plane's gap of surrogates has none."""
    return regex.finditer(f"{name}+", plane)


def splitter(pattern: str):
    """A function from a text to the pattern's matches, as the regex module finds them.

    The standard library lacks properties but matches about twice as fast; it gets the pattern with properties written
    out as ranges, for texts without characters beyond the Basic Multilingual Plane.
    """
    every = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", "[^{}]".format("".join(_classes().values()))).replace(r"\S", "[^{}]".format(_classes()[r"\s"]))
    for name, ranges in _classes().items():
        plain = plain.replace(name, f"[{ranges}]")
    try:
        near = re.compile(plain).findall
    except re.error:
        return every
    beyond = re.compile("[^\x00-\uffff]").search
    return lambda text: every(text) if beyond(text) else near(text)


class MergeReplay:
    """Encoder and decoder for one table of ranks; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = splitter(pattern)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = {i: token for token, i in ranks.items()}
        every = range(max(ranks.values()) + 1)
        self.names = pa.array([b"%d " % i for i in every], pa.large_binary())
        self.tokens = pa.array(map(self.bytes_of.get, every), pa.large_binary())
        self.pairs: dict[int, int] = {}

    def merged(self, left: int, right: int) -> int:
        """The id of two adjacent tokens' merge, or -1."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return found

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The encodings of words, by replaying all merges over all of them at once."""
        merged, known = self.merged, self.pairs.get
        token: list[int] = []  # -1 ends a word, -2 is merged into the token before
        starts = []
        for word in words:
            starts.append(len(token))
            token.extend(map(self.byte_ids.__getitem__, word))
            token.append(-1)
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i, (left, right) in enumerate(zip(token, token[1:], strict=False)):
            if left >= 0 and right >= 0:
                rank = known(left << 32 | right)
                if rank is None:
                    rank = merged(left, right)
                if rank >= 0:
                    if rank in index:
                        index[rank].append(i)
                    else:
                        index[rank] = [i]
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            for at, i in enumerate(positions):
                left = token[i]
                if left < 0 or (right := token[j := after[i]]) < 0 or known(left << 32 | right, -1) != rank:
                    continue
                token[i], token[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                sooner = False
                right = token[k]
                if right >= 0:
                    new = known(rank << 32 | right)
                    if new is None:
                        new = merged(rank, right)
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heappush(heap, new)
                        sooner = new <= rank
                h = before[i]
                if h >= 0 and (left := token[h]) >= 0:
                    new = known(left << 32 | rank)
                    if new is None:
                        new = merged(left, rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heappush(heap, new)
                        sooner |= new <= rank
                if sooner:  # a merge of this or a lower rank has come up: it may precede what is left here
                    if rank in index:
                        index[rank].extend(positions[at + 1 :])
                    elif at + 1 < len(positions):
                        index[rank] = positions[at + 1 :]
                        heappush(heap, rank)
                    break
        return [tuple(t for t in token[a:b] if t >= 0) for a, b in zip(starts, [*starts, n][1:], strict=True)]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word; words that are a token as a whole need no replay."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        coded = [word.encode() for word in words]
        out = [(whole,) if (whole := self.ranks.get(word)) is not None else None for word in coded]
        hard = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(hard, self.replay([coded[i] for i in hard]), strict=True):
            out[i] = found
        return out

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, in order; the texts are the corpus."""
        split = [self.split(text) for text in texts]
        words = list(set(chain.from_iterable(split)))
        ids = dict(zip(words, self.encode_words(words), strict=True))
        for found in split:
            yield list(chain.from_iterable(map(ids.__getitem__, found)))

    @staticmethod
    def digests(parts: pa.LargeBinaryArray, ids: pa.Array, last: np.ndarray, cut: int) -> pa.Array:
        """SHA-256 by document of its ids' parts (names or bytes) in a row, without the last `cut` bytes; last: the documents' edges in ids."""
        found = parts.take(ids)
        at = np.frombuffer(found.buffers()[1], np.int64)[last].tolist() if len(ids) else [0] * len(last)
        held = memoryview(found.buffers()[2] or b"")
        return pa.array([hashlib.sha256(held[a : max(a, b - cut)]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Lexicon:
    """The words that a worker has met, numbered, and the encodings of those replayed so far."""

    def __init__(self, codec: MergeReplay):
        self.codec = codec
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word gets the next number
        self.encodings = pa.array([], pa.list_(pa.int32()))

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def new(self) -> int:
        return len(self.number) - len(self.encodings)

    def tokens(self, numbers: np.ndarray) -> pa.ListArray:
        """The encodings of numbered words; the new ones are replayed first."""
        if self.new():
            found = self.codec.encode_words(list(islice(self.number, len(self.encodings), None)))
            self.encodings = pa.concat_arrays([self.encodings, pa.array(found, self.encodings.type)])
        return self.encodings.take(pa.array(numbers))


_lexicons: dict[str, Lexicon] = {}


def _lexicon(data: bytes, pattern: str, fresh: bool = False) -> Lexicon:
    """One lexicon a worker and table of ranks, kept between tasks; a fresh one keeps the codec alone."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _lexicons:
        _lexicons[key] = Lexicon(MergeReplay(parse_ranks(data), pattern))
    elif fresh:
        _lexicons[key] = Lexicon(_lexicons[key].codec)
    return _lexicons[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode every row's whole text; columns: the id, n_tokens, with ids the token ids, with digests two SHA-256.

    ids_sha256 is over the decimal ids joined by one space; decoded_sha256 is over the bytes that decoding the ids
    gives. A null text counts as empty (no ids). Rows are independent: repeated rows and null or repeated ids give a
    row each, an empty table gives an empty one, and columns other than the two named are not read. A very long text
    is a block of its own. The ranks file is read by the driver and broadcast; its size doesn't depend on the data.
    """
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    fields = [("n_tokens", "long", pa.int64())]
    fields += [("ids", "array<int>", pa.list_(pa.int32()))] * ids
    fields += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] * digests
    kind = df.schema[id_col].dataType.simpleString()

    def put_together(lexicon: Lexicon, doc_ids: list[pa.Array], numbers: list[np.ndarray]) -> pa.RecordBatch:
        tokens = lexicon.tokens(np.concatenate(numbers))
        flat, edge = tokens.flatten(), np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))
        edge = edge[np.append(0, np.cumsum([len(n) for n in numbers]))]
        columns = [pa.concat_arrays(doc_ids), pa.array(np.diff(edge), pa.int64())]
        if ids:
            columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), flat))
        if digests:
            columns += [lexicon.codec.digests(lexicon.codec.names, flat, edge, 1), lexicon.codec.digests(lexicon.codec.tokens, flat, edge, 0)]
        return pa.RecordBatch.from_arrays(columns, names=["id", *(name for name, _, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(data.value, pattern)
        doc_ids, numbers, size = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                doc_ids.append(batch.column(0).slice(i, 1))
                numbers.append(lexicon.numbers(lexicon.codec.split(text)))
                size += len(text)
                if size >= BLOCK_BYTES or lexicon.new() >= BLOCK_WORDS:
                    yield put_together(lexicon, doc_ids, numbers)
                    doc_ids, numbers, size = [], [], 0
                    if len(lexicon.number) > MEMO_WORDS:
                        lexicon = _lexicon(data.value, pattern, True)
        if doc_ids:
            yield put_together(lexicon, doc_ids, numbers)

    schema = ", ".join([f"id {kind}", *(f"{name} {sql}" for name, sql, _ in fields)])
    pairs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return pairs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and decoded binary of every row of token ids; null ids decode to empty bytes."""
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _lexicon(data.value, pattern).codec
        for batch in batches:
            out = pa.array([codec.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "decoded"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
