import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tidemark.llm.common import Workspace

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output over the small documents."""
    sf = "/root/testdata/sf0.01"
    docs, ws, out = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark, "test"), {}
    for name, stage in p.STAGES:
        kept = ws.stage(stage(spark, docs, sf), name)
        out[name] = docs, kept
        docs = kept
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality_classifier", "language_id", "exact_dedup", "ngram_jaccard_join", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns and after.count() > 0


def test_quality_drops_bad_and_keeps_good(spark, stages):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = before.join(labels, "doc_id").select("doc_id", "quality")
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    good = [r.doc_id in kept for r in known.filter("quality = 1").collect()]
    bad = [r.doc_id in kept for r in known.filter("quality = 0").collect()]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_exact_stage_keeps_the_least_id(stages):
    before, after = stages["exact_dedup"]
    least = {}
    for r in before.collect():
        key = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(least.values())


def test_near_stage_keeps_one_of_each_group(stages):
    before, after = stages["ngram_jaccard_join"]
    texts = {r.doc_id: r.text for r in before.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 80 * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    assert {r.doc_id for r in after.select("doc_id").collect()} == {find(i) for i in ids}


def test_packing_holds_all(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.select("doc_id").collect()}
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_edge_cases(spark, name):
    stage = dict(p.STAGES)[name]
    rows = [(1, "some words of a text here and there", "en", "s", 3, 1), (1, "some words of a text here and there", "en", "s", 3, 2), (None, None, None, None, None, 3), (2, "", "en", "s", 0, 4), (3, "word " * 20_000, "en", "s", 1, 5), (4, "some other words of a text altogether", None, "s", 1, 6)]
    df = spark.createDataFrame(rows, COLUMNS)
    kept = stage(spark, df, "/root/testdata/sf0.001").collect()
    assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0
    if name == "exact_dedup":
        assert sorted(r.doc_id for r in kept if r.text) == [1, 3, 4] and len(kept) == 4
    if name == "ngram_jaccard_join":
        assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]
    if name == "packing":
        assert len({(r.sequence_id, r.offset) for r in kept}) == len(kept)


@pytest.mark.parametrize("left_out", ["es", "fr"])
def test_language_stage_rejects_unknown_text(spark, left_out):
    """Random letters and a language without labels go, clean text stays."""
    sf, r = "/root/testdata/sf0.01", random.Random(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) > 300")
    junk = [(-k, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(100)), None) for k in range(1, 101)]
    truth = {d.doc_id: d.lang for d in docs.collect()}
    shown = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang"))).unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {d.doc_id for d in p.language_stage(spark, shown, sf).select("doc_id").collect()}
    share = lambda ids: len(kept & set(ids)) / len(ids)
    found = share(range(-100, 0)), share([i for i, x in truth.items() if x == left_out]), share([i for i, x in truth.items() if x and x != left_out])
    assert found[0] <= 0.02 and found[1] <= 0.1 and found[2] >= 0.97, found
