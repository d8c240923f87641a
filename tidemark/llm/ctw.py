"""Language-model scoring by context-tree weighting over bytes.

A text is its words (lower-cased in ASCII), joined by one space and ended by a line feed. Each byte is eight binary
decisions; each decision has a tree of contexts, which are the DEPTH bytes before (line feeds before the start). A
node's counts give a Krichevsky-Trofimov estimate, and the weighted probability of a node is the mean of its own and
the product of its children's, so the predictions mix all depths by how well each has coded the training texts. A
context that training never showed ends its path: the estimate there is that of the node above.

Documents are dealt by their place in the table to chunks of bounded size. Each chunk gives its distinct byte strings
of DEPTH + 1 and its distinct words with their counts in training documents; these are summed over all chunks. Strings
that share their last two context bytes form a group, in which all deeper nodes lie (at most 256 ** (DEPTH - 1) strings,
whatever the data's size); a group is worked off in slices of whole third bytes. The nodes above (65,280 at most a
level) are finished on the driver. Then each chunk gets the values of its own strings and words back and adds them up
by document. No table that grows with the data is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, with_place

#: Bytes of context.
DEPTH = 4
#: Bytes of text of a chunk, and of the documents that are coded at once; strings of a slice of a group; of a group whose slices are kept.
CHUNK_BYTES, CODED_BYTES, SLICE, KEPT = 24 << 20, 1 << 20, 1 << 16, 1 << 19
#: Counts by block that a chunk holds before it adds them up.
HELD = 1 << 20
_HALF = np.log(0.5)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The strings (context bytes, then the byte) of documents' bytes in order, and each document's first place."""
    pad = b"\n" * DEPTH
    parts = [pad + b" ".join(words) + b"\n" for words in documents]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    lengths = np.array([len(p) for p in parts])
    code = np.zeros(len(raw), np.int64)
    for k in range(DEPTH + 1):
        code[DEPTH:] |= raw[DEPTH - k : len(raw) - k] << (8 * k)
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.ones(len(raw), bool)
    for k in range(DEPTH):
        inside[start + k] = False
    return code[inside], np.concatenate(([0], np.cumsum(lengths - DEPTH)[:-1]))


def blocks(texts: Iterable[pa.StringScalar]):
    """The words of texts, in runs of bounded bytes; a chunk's words are never held all at once."""
    held, size = [], 0
    for text in texts:
        words = words_of(text.as_py())
        held.append(words)
        size += sum(map(len, words)) + len(words)
        if size > CODED_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def counts_of_chunk(docs: pa.Table) -> pa.Table:
    """The chunk's distinct strings and words, with their counts in its training documents (0: elsewhere only)."""
    found = [pd.Series([], np.zeros(0, np.int64), np.int64)]
    words: Counter[bytes] = Counter()
    learn = docs["learn"].to_numpy()
    for on in (True, False):
        for block in blocks(text for text, learns in zip(docs["text"], learn, strict=True) if learns == on):
            n = pd.Series(coded(block)[0]).value_counts(sort=False)  # by a hash table, which takes less than sorting
            found.append(n if on else n * 0)
            if sum(map(len, found[1:])) > HELD:
                found = [_added(found)]
            for d in block:
                if on:
                    words.update(d)
                else:
                    for w in d:
                        words.setdefault(w, 0)
    both = _added(found)
    codes, counts = both.index.to_numpy(), both.to_numpy()
    m, k = len(codes), len(words)
    return pa.table({
        "chunk": pa.repeat(docs["chunk"][0], m + k),
        "code": pa.chunked_array([pa.array(codes), pa.nulls(k, pa.int64())]),
        "word": pa.chunked_array([pa.nulls(m, pa.binary()), pa.array(list(words), pa.binary())]),
        "n": pa.chunked_array([pa.array(counts), pa.array(list(words.values()), pa.int64())]),
    }).combine_chunks()


def _added(counts: list[pd.Series]) -> pd.Series:
    return pd.concat(counts).groupby(level=0, sort=False).sum()


COUNTS = "chunk int, code long, word binary, n long"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: counts, estimates and weights, and each row's place among them."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, n: np.ndarray):
        self.keys, self.at = np.unique(keys, return_inverse=True)
        size = len(self.keys)
        self.counts = np.bincount(self.at * 2 + bits, weights=n, minlength=2 * size).reshape(size, 2)
        self.own = log_kt(self.counts[:, 0], self.counts[:, 1])
        self.weighted, self.share = self.own, np.ones(size)
        first = np.zeros(size, np.int64)
        first[self.at] = np.arange(len(self.at))
        self.first = first

    def above(self, below: Level) -> Level:
        """Mix in the children's weighted probabilities."""
        inner = np.bincount(self.at[below.first], weights=below.weighted, minlength=len(self.keys))
        self.weighted = np.logaddexp(_HALF + self.own, _HALF + inner)
        self.share = np.exp(_HALF + self.own - self.weighted)
        return self


def expand(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eight rows a string: the string, the decision's number (1 to 255, by the bits before it), its bit, the count."""
    symbol = code & 255
    j = np.arange(8)
    node = (1 << j)[None] | (symbol[:, None] >> (8 - j)[None])
    bit = (symbol[:, None] >> (7 - j)[None]) & 1
    return np.repeat(code, 8), node.ravel(), bit.ravel(), np.repeat(n, 8)


class Slice:
    """Strings of a group that share their third bytes with no other slice: decisions, bits, levels of depths 3 to DEPTH."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        wide, self.node, self.bit, self.n = expand(code, n)
        self.levels: list[Level] = []
        for depth in range(DEPTH, 2, -1):
            context = (wide >> 8) & ((1 << (8 * depth)) - 1)
            level = Level(context << 8 | self.node, self.bit, self.n)
            self.levels.insert(0, level.above(self.levels[0]) if self.levels else level)


class Group:
    """The strings of one group in slices, and its nodes of depth 2 as dense tables by decision."""

    def __init__(self, table: pa.Table):
        code, n = table["code"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(code >> 24 & 255, kind="stable")
        self.code, self.n = code[order], n[order]
        edges, sizes = [0], np.cumsum(np.bincount(code >> 24 & 255, minlength=256)).tolist()
        for before, upto in zip([0, *sizes], sizes, strict=False):
            if upto - edges[-1] > SLICE and before > edges[-1]:
                edges.append(before)
        self.edges = [*edges, len(code)]
        self.kept = [] if len(code) <= KEPT else None
        self.counts, self.inner = np.zeros((256, 2)), np.zeros(256)
        for part in self.parts():
            self.counts += np.bincount(part.node * 2 + part.bit, weights=part.n, minlength=512).reshape(256, 2)
            below = part.levels[0]
            self.inner += np.bincount(part.node[below.first], weights=below.weighted, minlength=256)
            if self.kept is not None:
                self.kept.append(part)
        own = log_kt(self.counts[:, 0], self.counts[:, 1])
        self.weighted = np.logaddexp(_HALF + own, _HALF + self.inner)
        self.share = np.exp(_HALF + own - self.weighted)

    def parts(self):
        if self.kept:
            yield from self.kept
        else:
            for a, b in zip(self.edges, self.edges[1:], strict=False):
                yield Slice(self.code[a:b], self.n[a:b])


def summary(table: pa.Table) -> pa.Table:
    """The depth-2 nodes of a group: what the nodes above need."""
    group = Group(table)
    node = np.flatnonzero(group.inner != 0)
    c1 = np.full(len(node), group.code[0] >> 8 & 255)
    return pa.table({"c1": pa.array(c1), "node": pa.array(node), "zeros": pa.array(group.counts[node, 0]), "ones": pa.array(group.counts[node, 1]), "inner": pa.array(group.weighted[node])})


class Upper:
    """Depths 0 and 1 as dense tables over (last byte, decision) and decision."""

    def __init__(self, rows: list):
        counts, inner = np.zeros((256, 256, 2)), np.zeros((256, 256))
        for r in rows:
            counts[r.c1, r.node] = r.zeros, r.ones
            inner[r.c1, r.node] = r.inner
        self.counts = [counts.sum(axis=0), counts]
        self.share = []
        for c, own_inner in ((counts, inner), (self.counts[0], None)):
            own = log_kt(c[..., 0], c[..., 1])
            if own_inner is None:
                own_inner = weighted.sum(axis=0)  # noqa: F821 - of the depth below, from the round before
            weighted = np.logaddexp(_HALF + own, _HALF + own_inner)
            self.share.insert(0, np.exp(_HALF + own - weighted))


def price(table: pa.Table, upper: Upper) -> pa.Table:
    """log10 of each string's last byte's probability after its context."""
    group = Group(table)
    c1 = int(group.code[0]) >> 8 & 255
    dense = [(upper.counts[0], upper.share[0]), (upper.counts[1][c1], upper.share[1][c1]), (group.counts, group.share)]
    values = []
    for part in group.parts():
        estimates = [(counts[part.node], share[part.node]) for counts, share in dense]
        estimates += [(level.counts[level.at], level.share[level.at]) for level in part.levels]
        p = seen = None
        for counts, share in reversed(estimates):
            total = counts.sum(axis=1)
            own = (counts[np.arange(len(part.bit)), part.bit] + 0.5) / (total + 1)
            p = own if p is None else np.where(seen, share * own + (1 - share) * p, own)
            seen = total > 0
        values.append(np.log10(p).reshape(-1, 8).sum(axis=1))
    return pa.table({"code": pa.array(group.code), "value": pa.array(np.concatenate(values))})


def score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text, learning from the rows where `learn` holds.

    Columns: the id, learn, n_tokens (words and one end), n_known (tokens that training has), train_tokens, base_score
    (add-0.1 unigram), score (log10 probability of the text), n_bytes, bits_per_byte. A null text is empty: its end
    alone is scored. Rows are independent, so repeated rows and null or repeated ids get a row each and are spread over
    the chunks like others; a very long text makes its chunk longer by itself. With no training rows all estimates are
    1/2. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "ctw")
    rows = with_place(df, ws).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), "__place")
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.count_if("learn")).first()
    chunks = max(1, -(-(size or 0) // CHUNK_BYTES))
    docs = rows.withColumn("chunk", F.pmod(F.xxhash64("__place"), F.lit(chunks)).cast("int")).drop("__place")
    counts = ws.stage(docs.select("chunk", "text", "learn").groupBy("chunk").applyInArrow(counts_of_chunk, COUNTS), "counts")

    strings = counts.filter("code is not null")
    tree = ws.stage(strings.groupBy("code").agg(F.sum("n").alias("n")), "strings")
    grouped = tree.groupBy(F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("group"))
    upper = Upper(grouped.applyInArrow(summary, "c1 long, node long, zeros double, ones double, inner double").groupBy("c1", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("inner").alias("inner")).collect())
    priced = grouped.applyInArrow(lambda group: price(group, upper), "code long, value double")
    valued = strings.select("chunk", "code").join(priced, "code").select("chunk", "code", F.lit(None).cast("binary").alias("word"), "value")

    # A word's rows: one for each chunk that has it.
    words = counts.filter("word is not null")
    of_word = ws.stage(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = of_word.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    known = words.select("chunk", "word").join(of_word, "word").select("chunk", F.lit(None).cast("long").alias("code"), "word", F.col("c").cast("double").alias("value"))
    floor = np.log10(total + 0.1 * (distinct + 1))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"

    def add_up(docs: pa.Table, values: pa.Table) -> pa.Table:
        value = values["value"].to_numpy()
        is_code = values["code"].is_valid().to_numpy()
        code = values["code"].filter(pa.array(is_code)).to_numpy()
        place, logs = pd.Index(code), value[is_code]
        c = value[~is_code]
        names = values["word"].filter(pa.array(~is_code)).to_pylist()
        base = dict(zip(names, (np.log10(c + 0.1) - floor).tolist(), strict=True))
        fresh = {w for w, x in zip(names, c.tolist(), strict=True) if x == 0}
        del names, values
        end = float(np.log10(ends + 0.1) - floor)
        out: list[tuple] = []
        for block in blocks(docs["text"]):
            strings, start = coded(block)
            sums = np.add.reduceat(logs[place.get_indexer(strings)], start)
            sizes = np.diff(np.append(start, len(strings)))
            for d, s, b in zip(block, sums.tolist(), sizes.tolist(), strict=True):
                new = sum(map(fresh.__contains__, d))
                out.append((len(d) + 1, len(d) - new + (ends > 0), sum(map(base.__getitem__, d)) + end, s, b))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.Table.from_arrays([docs["id"], docs["learn"], *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["id", "learn", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    found = docs.select("chunk", "id", "text", "learn").groupBy("chunk").cogroup(valued.unionByName(known).groupBy("chunk")).applyInArrow(add_up, schema)
    return found.select(F.col("id").alias(id_col), "learn", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))
