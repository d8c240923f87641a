import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality
from tidemark.llm.queries import QUERIES


def test_profile_is_the_bundle_of_bound_permuted_letters():
    """Against the definition, letter by letter."""
    text, letters = "Ab, ça", langid.Letters(langid.DIMENSIONS, langid.ORDER)
    codes = [0, *map(ord, "ab"), 0, *map(ord, "ça"), 0]
    total = np.zeros(langid.DIMENSIONS)
    for i in range(len(codes) - 2):
        total += np.prod([letters.vectors(codes[i + 2 - k])[k].astype(int) for k in range(3)], axis=0)
    found = langid.profiles([text, "", "12 !"])
    assert np.allclose(found[0], total / np.linalg.norm(total), atol=1e-6)
    assert not found[1:].any()


def test_batches_and_very_long_texts_agree():
    texts = ["hello world", "la maison", "日本語 の テキスト", "x" * 50_000, "ab " * 20_000] * 80
    whole = langid.profiles(texts)
    assert np.allclose(whole[:5], langid.profiles(texts[:5]), atol=1e-6) and np.allclose(whole[-5:], whole[:5], atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    found = QUERIES["op3_language_id"](spark, sf).join(docs, "doc_id")
    r = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.a > 0.97 and 0 <= r.lo and r.hi <= 1
    assert found.count() == docs.count()


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat and the hat", "en"), (2, "der Hund und die Katze sind nicht da", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "the cat and", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.p for r in df.select("doc_id", langid.predict(model, F.col("text")).alias("p")).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "en"] and got[3].score == 0
    none = langid.train(df.limit(0))
    assert none.predict(["the"])[0] == ["und"]


def test_query_against_plain_profiles(spark, small):
    """op3 whole: prototypes added up document by document, then one cosine after the other."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    sums = {}
    for d in docs:
        if d.text and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 5:
            sums[d.lang] = sums.get(d.lang, 0) + langid.profiles([d.text])[0].astype(float)
    names = sorted(k for k, v in sums.items() if v.any())
    unit = lambda v: v / np.linalg.norm(v)
    prototypes = [unit(sums[k]) for k in names]
    mean = np.mean(prototypes, axis=0)
    prototypes = [unit(p - mean) for p in prototypes]
    found = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, small).collect()}
    assert len(found) == len(docs)
    for d in docs:
        vector, r = langid.profiles([d.text or ""])[0], found[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
        if not vector.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = np.array([unit(vector - mean) @ p for p in prototypes])
        top = np.sort(cosines)[::-1]
        assert r.lang_pred == names[int(cosines.argmax())] or top[0] - top[1] < 1e-4
        assert abs(r.score - 1 / np.exp(langid.STEEPNESS * (cosines - cosines.max())).sum()) < 1e-3


def test_languages_are_bounded(spark):
    df = spark.createDataFrame([(f"text of language {k}", f"l{k}") for k in range(9) for _ in range(9 - k)], "text string, lang string")
    assert langid.train(df, languages=3).languages == ["l0", "l1", "l2"]


def test_repeated_ids_and_clashing_labels_train_once(spark):
    docs = spark.createDataFrame([(k % 4, f"text number {k % 8}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 4, k % 2) for k in range(40)] + [(0, 1)], "doc_id long, quality int")
    kept = []
    fit = quality.fit
    try:
        quality.fit = lambda x, y: kept.append((len(x), y.tolist())) or fit(x, y)
        quality.train(docs, labels, sample=3)
    finally:
        quality.fit = fit
    assert kept[0][0] == 3


def test_quality_query_against_one_document_at_a_time(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").filter("quality is not null").collect()
    learned = sorted((r.doc_id, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs)
    model = quality.fit(quality.features([docs[i] for i, _ in learned]), np.array([y for _, y in learned], float))
    for r in QUERIES["op9_quality"](spark, small).collect():
        assert abs(r.score - model.score(quality.features([docs[r.doc_id]]))[0]) < 1e-9
        assert r.predicted == (r.score >= 0.3)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    for row, score in zip(x[3000:3010], trees.score(x[3000:3010]), strict=True):  # node by node
        margin = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.limit[t, node])
            margin += trees.value[t, node - trees.feature.shape[1]]
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-12


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES["op9_quality"](spark, sf)
    r = found.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert r > 0.95
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0)], [(1, 1), (1, 1), (2, 0)]])
def test_quality_edge_cases(spark, labels):
    docs = spark.createDataFrame([(1, "good text here", 5), (2, None, 6), (3, "", 7), (4, "\u0000 \n\t ", 8), (None, "x" * 100_000, 9)], "doc_id long, text string, y int")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = [r.s for r in docs.select(quality.score(model, F.col("text")).alias("s")).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
