import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, ngram_join
from tidemark.llm.common import Workspace, give_back, join_spread
from tidemark.llm.components import connected_components
from tidemark.llm.queries import QUERIES


def find_all(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(random.Random(k).randrange(200), random.Random(-k).randrange(200)) for k in range(1, 120)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in connected_components(df, Workspace(spark, "test")).collect()}
    assert found == find_all({x for e in edges for x in e}, edges)


def jaccard_brute(docs, width, num, den):
    sets = {}
    for i, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(docs)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    components = find_all(ids, links)
    return sorted((i, len(sets[i]), components[i]) for i in ids)


def near_copies(seed, groups=6, size=14, vocabulary=300):
    """Groups around the threshold: copies with none to many words replaced, added or cut, and passages in common."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passage = [word() for _ in range(60)]
    docs = {}
    for g in range(groups):
        base = [word() for _ in range(r.choice([5, 9, 14, 25, 60, 150, 400]))]
        for _ in range(size):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                at, kind = r.randrange(len(text)), r.randrange(3)
                text[at : at + (kind != 1)] = [word()] * (kind != 2)
            if r.random() < 0.2:
                text[1:1] = passage
            docs[len(docs)] = (" " if r.random() < 0.5 else "\n ").join(text).upper() if r.random() < 0.2 else " ".join(text)
    docs |= {len(docs): None, len(docs) + 1: "", len(docs) + 2: " \n", len(docs) + 3: "one", len(docs) + 4: "ONE", len(docs) + 5: "a b", len(docs) + 6: "É x y z", len(docs) + 7: "é x y z"}
    return docs


@pytest.mark.parametrize("seed, width, num", [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60)])
def test_join_loses_no_link(spark, monkeypatch, seed, width, num):
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 300 if seed % 2 else 200_000)
    docs = near_copies(seed)
    df = spark.createDataFrame([(i, t, "n") for i, t in docs.items()], "doc_id long, text string, node string").repartition(3)
    assert sorted(map(tuple, ngram_join.ngram_components(df, width, num, 100).collect())) == jaccard_brute(docs, width, num, 100)


@pytest.mark.parametrize("held", [1_500_000, 700])
@pytest.mark.parametrize("width, num", [(4, 85), (5, 80)])
def test_large_families_keep_their_first_set(spark, monkeypatch, held, width, num):
    """Families of 24 near copies in one task, whose contents are met there; a small held flushes amid them."""
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    r, docs = random.Random(9), {}
    for size in (80, 150, 300):
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        for _ in range(24):
            text = list(base)
            text[r.randrange(size)] = f"x{len(docs)}"
            docs[len(docs)] = " ".join(text)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(1)
    assert sorted(map(tuple, ngram_join.ngram_components(df, width, num, 100).collect())) == jaccard_brute(docs, width, num, 100)


def test_fragments_of_linked_sets_meet():
    """The guarantee itself: of random linked pairs, each has a content in common."""
    rng = np.random.default_rng(5)
    for num in (85, 80, 60):
        cuts = ngram_join.Cuts(num, 100)
        for _ in range(400):
            n = int(rng.integers(2, 500))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            for _ in range(int(rng.integers(0, max(2, n // 3)))):
                if rng.random() < 0.6 and len(b) > 1:
                    b = np.delete(b, rng.integers(0, len(b)))
                if rng.random() < 0.5:
                    b = np.unique(np.append(b, rng.integers(0, 2**63, 1).astype(np.uint64)))
            common, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * common < num * both or (len(a) == len(b) == common):
                continue
            sets = ngram_join.Sets([], 4)
            sets.sizes, sets.grams, sets.start = np.array([len(a), len(b)]), np.concatenate((a, b)), np.array([0, len(a)])
            found, owner = ngram_join.contents(sets, np.array([0, 1]), cuts)
            assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())


def test_sets_with_one_hash_go_by_their_other():
    sets = ngram_join.Sets(["a b c d e f", "", "u v w x y z", "A b c d e f"], 4)
    name, other = sets.names()
    assert name[0] == name[2] != name[1] and other[0] == other[2] != other[1]
    assert sets.nodes(frozenset([int(name[1])])).tolist() == [name[0], other[1], name[2]]


def test_wide_n_grams_tell_the_order_of_words_apart():
    words = [f"w{k}" for k in range(12)]
    swapped = [*words[8:9], *words[1:8], words[0], *words[9:]]
    sets = ngram_join.Sets([" ".join(words), " ".join(swapped), " ".join(words[:10]), " ".join(swapped[:10])], 12)
    assert len(set(sets.nodes().tolist())) == 4


def test_a_hot_key_is_split(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_spread(rows, table, ["k"], "n", 3000, F.col("id"))
    assert joined.count() == 3000 and joined.filter("n = 2000").count() == 2000
    assert join_spread(rows, table, ["k"], "n", 3000, F.col("id"), "left_semi").count() == 3000


def test_join_repeated_rows_and_ids(spark):
    df = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (1, "A B C D E F"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert rows == sorted([(2, 2, 1), (2, 2, 1), (1, 2, 1), (None, 2, 1), (3, 0, 3)], key=str)
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_join_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sorted(map(tuple, QUERIES["op8_ngram_join"](spark, small).collect())) == jaccard_brute(docs, 4, 85, 100)


def cosine_brute(rows, threshold):
    sound = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max(map(len, sound.values()), default=0)
    sound = {i: np.pad(v, (0, width - len(v))) for i, v in sound.items()}
    links = [(a, b) for a in sound for b in sound if a < b and sound[a] @ sound[b] / np.sqrt((sound[a] @ sound[a]) * (sound[b] @ sound[b])) >= threshold]
    components = find_all([i for i, _ in rows], links)
    degree = {i: sum(i in link for link in links) for i, _ in rows}
    return sorted((i, degree[i], components[i], components[i] == i) for i, _ in rows)


@pytest.mark.parametrize("seed, tile", [(1, 2048), (2, 16), (3, 7)])
def test_embeddings_against_brute_force(spark, seed, tile):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 20))
    rows = [(i, (centres[rng.integers(12)] + rng.choice([0, 0.1, 0.3, 0.6]) * rng.normal(size=20)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, []), (302, [0.0] * 20), (303, [1.0, None]), (304, [float("nan")] * 3), (305, [float("inf"), 1.0]), (306, [1.0]), (307, [2.0, 0.0]), (308, [-x for x in rows[0][1]]), (309, [1e200 * x for x in rows[0][1]])]
    expected = cosine_brute([r for r in rows if r[0] != 309], 0.9)
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, size long").repartition(4)
    found = sorted(map(tuple, embed_dedup.near_duplicates(df.filter("vec_id <> 309"), 0.9, tile=tile).collect()))
    assert found == expected
    huge = {r.vec_id: r for r in embed_dedup.near_duplicates(df.filter("vec_id in (0, 309)"), 0.9).collect()}
    assert huge[309].component_id == 0 and huge[0].n_links == 1


def test_embeddings_at_the_threshold(spark):
    """3-4-5: a cosine of exactly 0.6 counts."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [-4.0, 3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embed_dedup.near_duplicates(df, 0.6).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_embeddings_repeated_ids_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted((tuple(r) for r in embed_dedup.near_duplicates(df, 0.9).collect()), key=str)
    assert rows == sorted([(1, 1, 1, True), (1, 0, 1, True), (None, 1, 1, False)], key=str)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embed_dedup.near_duplicates(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 3


def test_sets_that_reach_a_class_need_no_meeting_of_all():
    """At 0.8 the least sets that reach into the next class fill fewer fragments than any of it can differ in, but more than they can."""
    rng, cuts = np.random.default_rng(6), ngram_join.Cuts(80, 100)
    for k in range(8, 14):
        size = -(-cuts.limit(k) * 80 // 100)
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) * np.uint64(2)
        b = a.copy()
        b[: size // 9] = rng.integers(0, 2**63, size // 9).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        sets = ngram_join.Sets([], 5)
        sets.sizes, sets.grams, sets.start, sets.some = np.array([size, size]), np.concatenate((a, np.sort(b))), np.array([0, size]), np.arange(2)
        found, owner = ngram_join.contents(sets, np.array([0, 1]), cuts)
        assert not (found & np.uint64(3) == 2).any()
        common = set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())
        need = ngram_join.needs(sets, cuts)
        for flag in (0, 1):
            met = [x for x in common if x & 3 == flag]
            assert not any(found & np.uint64(3) == flag) or len(met) >= need[flag].max()


@pytest.mark.parametrize("width, num", [(4, 85), (5, 80)])
def test_passages_make_no_large_family(spark, monkeypatch, width, num):
    """Texts that share frequent passages but aren't linked are compared by pairs that can be, not all with all."""
    seen = []
    plain = ngram_join._compare_families
    monkeypatch.setattr(ngram_join, "_compare_families", lambda left, *rest: seen.append(left.groupBy("family").count().agg(F.max("count")).first()[0]) or plain(left, *rest))
    r = random.Random(11)
    passages = [[f"p{k}-{x}" for x in range(14)] for k in range(12)]
    docs = {}
    for _ in range(60):
        base = [f"w{r.randrange(100_000)}" for _ in range(60)]
        for p in r.sample(passages, 3):
            base += p
        for _ in range(2):
            text = list(base)
            for at in r.sample(range(60), 4):
                text[at] = f"x{r.randrange(100_000)}"
            docs[len(docs)] = " ".join(text)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, ngram_join.ngram_components(df, width, num, 100).collect())) == jaccard_brute(docs, width, num, 100)
    assert (seen[0] or 0) <= 8


def test_tiles_of_a_family_are_compared_by_many_tasks(spark, monkeypatch):
    """Names of pairs of tiles are few bytes, but each pair is a comparison; sets of one large component are compared with others only."""
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 2000)
    base, rows, spelt = list(range(1, 41)), [], []
    for node in range(60):
        grams = [*base[: 35 + node % 3], 1000 + node]
        component = 100 if node < 30 else 200 + node  # a component beyond a tile, and sets alone
        rows.append((node, 7, component, len(grams), len(grams)))
        spelt += [(node, part, grams[10 * part : 10 * part + 10]) for part in range(4)]
    left = spark.createDataFrame(rows, "node long, family long, component long, n int, common int")
    parts = spark.createDataFrame(spelt, "node long, part int, grams array<long>")
    links = ngram_join._compare_families(left, parts, 85, 100, Workspace(spark, "test")).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in links}) > 4
    assert not any(r.a < 30 and r.b < 30 for r in links)
    joined = find_all(range(60), [(r.a, r.b) for r in links] + [(k, k + 1) for k in range(29)])
    assert set(joined.values()) == {0}


def test_workers_keep_no_words_and_no_free_memory():
    ngram_join.Sets(["a b c d e f"], 4)
    assert ngram_join._hashes
    ngram_join.forget()
    assert not ngram_join._hashes

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    held = [bytes(60_000) for _ in range(2000)]
    last = held[-1]
    del held
    before = resident()
    give_back()
    assert before - resident() > 60_000_000 and len(last) == 60_000
