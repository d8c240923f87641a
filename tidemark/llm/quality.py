"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on the driver over a bounded sample of labelled rows (SAMPLE, picked by a hash of the id) and
flattened into arrays; a batch of documents goes through all trees level by level in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back

#: Labelled rows that the trees are fitted on at most.
SAMPLE = 20_000
#: Trees, their depth, bins of a feature, shrinkage, L2 of leaf values, least rows of a leaf.
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 20

FEATURES = (
    "bytes", "words", "word_mean", "word_sd", "word_max", "lower", "upper", "digit", "space", "high", "sentence_marks", "other_marks", "marks_at_word_end",
    "entropy", "distinct_words", "top_word", "herdan", "pair_repeats", "short_words", "lines", "line_repeats", "line_mean", "capital_words", "capital_starts", "digit_words", "last_mark", "byte_runs", "letters_distinct",
)
_KIND = np.full(256, 5)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"-")):
    _KIND[list(_chars)] = _k
_KIND[128:] = 6


def statistics(text: str) -> list[float]:
    """The features of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data.strip():
        return [float(len(data))] + [0.0] * (len(FEATURES) - 1)
    raw = np.frombuffer(data, np.uint8)
    n, counts = len(raw), np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7) / n
    p = counts[counts > 0] / n
    words = data.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    space = _KIND[raw] == 3
    ends = raw[:-1][~space[:-1] & space[1:]]
    starts = raw[1:][space[:-1] & ~space[1:]]
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), lengths.max(), *kinds[[0, 1, 2, 3, 6, 4, 5]], np.isin(_KIND[ends], (4, 5)).mean() if len(ends) else 0.0,
        -(p * np.log2(p)).sum(), len(seen) / m, max(seen.values()) / m, np.log(len(seen) + 1) / np.log(m + 1), 1 - len(set(zip(words, words[1:], strict=False))) / max(m - 1, 1), (lengths <= 2).mean(),
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines), sum(map(bytes.isupper, words)) / m, (_KIND[starts] == 1).mean() if len(starts) else 0.0,
        (np.add.reduceat(_KIND[raw] == 2, np.flatnonzero(np.concatenate(([True], space[:-1])))) > 0).sum() / m, float(_KIND[data.rstrip()[-1]] in (4, 5)), (raw[1:] == raw[:-1]).mean() if n > 1 else 0.0, (counts[97:123] > 0).sum(),
    ]


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Complete binary trees as arrays: node i has the children 2i + 1 and 2i + 2; the last level holds values."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        while node[0, 0] < inner if len(x) else False:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        return 1 / (1 + np.exp(-self.base - self.value[trees, node - inner].sum(axis=1)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting of the logistic loss; splits are searched over histograms of gradients by bin."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), base)
    out = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for f, bins in enumerate(binned):
                if not len(edges[f]):
                    continue
                key = (node - first) * BINS + bins
                gh = [np.bincount(key, weights=w, minlength=width * BINS).reshape(width, BINS) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = (np.cumsum(a, axis=1)[:, :-1] for a in gh), (a.sum(axis=1, keepdims=True) for a in gh)
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k] = top[k]
                    out.feature[t, first + k], out.limit[t, first + k] = f, edges[f][min(at[k], len(edges[f]) - 1)]
            f = out.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > out.limit[t, node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + L2)
        out.value[t] = value
        margin += value[leaf]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most `sample` labelled documents: those with the least hash of the id.

    Null ids and labels are left out; of several labels of one id the least holds, and of several documents with one id
    the text with the least hash. A null text is empty, texts count whole whatever their length, and other columns are
    not read. Without labelled documents, or with labels of one kind alone, the model is a constant.
    """
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # at most `sample` ids
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")).select("id", "y", "t.text")

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts.tolist())))

    found = rows.select("id", "y", measure("text").alias("x")).collect()
    found.sort(key=lambda r: (r.id, r.y, r.x))
    return fit(np.array([r.x for r in found], float).reshape(len(found), len(FEATURES)), np.array([r.y for r in found], float))


def score(model: Trees, text: Column) -> Column:
    """The score (0 to 1) of a text column, by the whole text alone; a null text counts as empty, equal texts score alike."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        found = pd.Series(model.score(features(texts.tolist())))
        give_back()
        return found

    return run(F.coalesce(text, F.lit("")))
