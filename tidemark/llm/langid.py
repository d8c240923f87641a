"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a document's vector bundles (sums) the vectors of all its n-grams. A language's
prototype bundles the unit vectors of its documents, and a document gets the language whose prototype has the
largest cosine with it. Vectors of prototypes and documents are taken relative to the mean of the prototypes, which
holds what all languages share.

Training sums over all labelled rows: each task bundles its own, and the sums are added by (language, dimension).
What reaches the driver is languages x dimensions, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back

#: Dimensions of the vectors, letters of an n-gram, and the steepness of the score in the cosine.
DIMENSIONS, ORDER, STEEPNESS = 1024, 3, 12.0
#: Documents and distinct n-grams that are multiplied at once.
DOCS, SLAB = 256, 4096
UNKNOWN = "und"
#: Languages that a model has at most: those with the most rows (ties: by name).
LANGUAGES = 500
#: Letters at which the classes of length begin, short texts' profiles being noisy; steps of a cosine of 1 that floors are told by.
LENGTHS, STEPS = (0, 200), 1000
RESULT = "lang_pred string, score double, similarity double"


class Letters:
    """Random vectors by letter; the same in every process, as the letter is the seed."""

    def __init__(self, dimensions: int, order: int):
        self.dimensions, self.order, self.known = dimensions, order, {}

    def vectors(self, code: int) -> np.ndarray:
        """The vector of a letter (0: whatever stands between words) rotated by 0, 1, ... places."""
        if code not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            v = np.random.default_rng(code).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            self.known[code] = np.stack([np.roll(v, k) for k in range(self.order)]).astype(np.int8)
        return self.known[code]


_letters: dict[tuple[int, int], Letters] = {}
_class: dict[int, bool] = {}


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every run of other characters as one 0, with a 0 at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ascii_letter = (codes >= 97) & (codes <= 122)
    high = np.flatnonzero(codes >= 128)
    if len(high):
        seen, at = np.unique(codes[high], return_inverse=True)
        for c in seen.tolist():
            if c not in _class:
                _class[c] = chr(c).isalpha()
        ascii_letter[high] = np.array([_class[c] for c in seen.tolist()])[at]
    codes[~ascii_letter] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def profiles(texts: list[str], dimensions: int = DIMENSIONS, order: int = ORDER) -> np.ndarray:
    """Unit vectors (rows) of texts; zero for a text without letters."""
    letters = _letters.setdefault((dimensions, order), Letters(dimensions, order))
    out = np.zeros((len(texts), dimensions), np.float32)
    for start in range(0, len(texts), DOCS):
        coded = [letter_codes(t) for t in texts[start : start + DOCS]]
        alphabet, flat = np.unique(np.concatenate(coded), return_inverse=True)
        size = len(alphabet)
        grams, docs, at = [], [], 0
        for d, codes in enumerate(coded):
            own = flat[at : at + len(codes)]
            at += len(codes)
            if codes.any() and len(own) >= order:
                n = len(own) - order + 1
                gram = np.zeros(n, np.int64)
                for k in range(order):
                    gram = gram * size + own[k : k + n]
                grams.append(gram)
                docs.append(np.full(n, d, np.int64))
        if not grams:
            continue
        seen, at_gram = np.unique(np.concatenate(grams), return_inverse=True)
        doc = np.concatenate(docs)
        table = np.stack([letters.vectors(int(c)) for c in alphabet])
        block = out[start : start + DOCS]
        for low in range(0, len(seen), SLAB):
            part = seen[low : low + SLAB]
            bound, rest = np.ones((len(part), dimensions), np.int8), part
            for k in range(order):
                rest, letter = np.divmod(rest, size)
                bound *= table[letter, k]
            here = (at_gram >= low) & (at_gram < low + SLAB)
            counts = np.bincount(doc[here] * len(part) + at_gram[here] - low, minlength=len(coded) * len(part))
            block += counts.reshape(len(coded), -1).astype(np.float32) @ bound.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class LanguageModel:
    languages: list[str]
    prototypes: np.ndarray  # unit rows, relative to the mean
    mean: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and cosine by text; `und`, 0 and -1 where there is no letter or no language."""
        vectors = profiles(texts)
        empty = ~vectors.any(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -1.0)
        vectors = vectors - self.mean
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        cosines = (np.divide(vectors, norm, out=vectors, where=norm > 0) @ self.prototypes.T).astype(np.float64)
        best = cosines.argmax(axis=1)
        top = cosines[np.arange(len(texts)), best]
        score = 1 / np.exp(STEEPNESS * (cosines - top[:, None])).sum(axis=1)
        return [UNKNOWN if e else self.languages[b] for e, b in zip(empty, best, strict=True)], np.where(empty, 0, score), np.where(empty, -1, top)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> LanguageModel:
    """Prototypes from all rows with a language and a text with letters; a model without languages if there are none.

    At most `languages` languages are learned, those with the most rows, so a column with many stray values can't make
    the model grow. Rows with a null language or text teach nothing, repeated rows count each time, texts count whole
    whatever their length, and other columns are not read.
    """
    lang = F.col(lang_col).cast("string")
    names = [r.lang for r in df.filter(lang.isNotNull() & F.col(text_col).isNotNull()).groupBy(lang.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages).collect()]

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            vectors = profiles(batch.column(1).to_pylist())
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
            del vectors
            give_back()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = df.select(lang.alias("lang"), F.col(text_col).alias("text")).dropna().filter(F.col("lang").isin(names))
    # Each sum in units of 2**-20, so that the order in which tasks end can't change the total.
    parts = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("d", "x"))
    totals = parts.groupBy("lang", "d").agg(F.sum(F.round(F.col("x") * 2**20).cast("long")).alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    found = [(r.lang, np.array([x for _, x in r.v], float)) for r in totals.orderBy("lang").collect()]
    found = [(lang, v / np.linalg.norm(v)) for lang, v in found if v.any()]
    if not found:
        return LanguageModel([], np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS))
    prototypes = np.stack([v for _, v in found])
    mean = prototypes.mean(axis=0) if len(found) > 1 else np.zeros(prototypes.shape[1])
    prototypes = prototypes - mean
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel([lang for lang, _ in found], (prototypes / np.where(norm > 0, norm, 1)).astype(np.float32), mean.astype(np.float32))


def predict(model: LanguageModel, text: Column) -> Column:
    """A struct column (lang_pred, score, similarity) of a text column; null counts as a text without letters.

    Whole texts count, however long; equal texts get equal results, and of languages with equal cosines the first by name wins.
    """
    shared = model

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, cosine = shared.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score, "similarity": cosine})

    return run(F.coalesce(text, F.lit("")))


def length_classes(texts: list[str]) -> np.ndarray:
    return np.searchsorted(LENGTHS, [np.count_nonzero(letter_codes(t)) for t in texts], "right") - 1


def floors(model: LanguageModel, df: DataFrame, share: float, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """Least cosine by language and class of length: that which `share` of the training rows of both stay below.

    Every row of training counts, by its cosine with the prototype of its own language; what reaches the driver are
    counts by language, class and step. A class that a language has no row in takes the floor of the next shorter one.
    """
    number = {lang: k for k, lang in enumerate(model.languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors = profiles(texts)
            use = np.array([lang in number for lang in langs], bool) & vectors.any(axis=1)
            own = np.array([number.get(lang, 0) for lang in langs], np.int64)
            vectors = vectors - model.mean
            norm = np.linalg.norm(vectors, axis=1)
            cosine = (vectors * model.prototypes[own]).sum(axis=1) / np.where(norm > 0, norm, 1)
            found = np.stack([own, length_classes(texts), np.floor(cosine * STEPS).astype(np.int64)], axis=1)[use]
            key, n = np.unique(found, axis=0, return_counts=True)
            del vectors, texts
            give_back()
            yield pa.RecordBatch.from_arrays([*(pa.array(key[:, k]) for k in range(3)), pa.array(n)], names=["lang", "size", "step", "n"])

    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = rows.mapInArrow(count, "lang long, size long, step long, n long").groupBy("lang", "size", "step").agg(F.sum("n").alias("n")).collect()
    out = np.full((len(model.languages), len(LENGTHS)), np.nan)
    for lang, size in {(r.lang, r.size) for r in counts}:
        step, n = np.array(sorted((r.step, r.n) for r in counts if (r.lang, r.size) == (lang, size))).T
        out[lang, size] = step[np.searchsorted(np.cumsum(n), share * n.sum(), "right")] / STEPS
    for size in range(1, len(LENGTHS)):
        out[:, size] = np.where(np.isnan(out[:, size]), out[:, size - 1], out[:, size])
    for size in range(len(LENGTHS) - 2, -1, -1):
        out[:, size] = np.where(np.isnan(out[:, size]), out[:, size + 1], out[:, size])
    return out


def known(model: LanguageModel, least: np.ndarray, text: Column) -> Column:
    """Whether a text is at its language's floor for its length or above; false for a text without letters."""
    shared = model

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        lang, _, cosine = shared.predict(texts)
        give_back()
        place = np.array([shared.languages.index(x) if x != UNKNOWN else -1 for x in lang], np.int64)
        return pd.Series((place >= 0) & (cosine >= least[place, length_classes(texts)]))

    return run(F.coalesce(text, F.lit("")))
