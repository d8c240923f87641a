"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments (ranges of the order), and so is
every document's set.

Candidates: sets with a similarity of num/den or more differ in at most H n-grams, so of more than H fragments at
least one is alike in both. The number of fragments goes by the sets' size: sizes fall into classes, a class reaches
into the next one only, and each set is cut for its own class and the next. A fragment's content is hashed and sets
meet where a content is the same. Empty fragments say nothing; a set with so few others that the bound would need
them is cut by a second order, and one that has no more of either than can differ meets all such sets of its class. So
no link is lost.

Star instead of all pairs: of the sets that share a content, each is compared with one (the least), so a group of
near copies costs as many comparisons as it has members. Only where such a comparison fails are the members compared
further, pair by pair, and only if they are not in one component yet. Sets whose content one task sees many times are
known to meet others before the shuffle, so they spread over its partitions; the task's first one stays with the rest.
What is compared further: linked sets have some contents in common, so each may leave out that many less one, its most
frequent ones, and pairs of the rest that are alike enough in size and share of common n-grams make the families.

Comparison: partial overlaps are counted fragment by fragment (PARTS ranges of the order) and summed per pair.

Copies (equal sets) are one node. The result is each document's component, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, give_back, join_spread
from tidemark.llm.components import connected_components

#: Fragments that overlaps are counted in; orders that a set is cut by before it meets all of its class.
PARTS, ORDERS = 4, 2
#: Powers of the threshold that a size class spans; fragments beyond those that can differ, in per cent.
WIDTH, MARGIN = 3, 22
#: N-grams of a tile of sets that are compared with each other; columns of a fragment of the order there.
TILE_GRAMS, FRAGMENT = 200_000, 4096
#: N-grams that a set counts for besides its own, so that a tile has at most TILE_GRAMS / SET_COST sets.
SET_COST = 200
#: Tasks that pairs of tiles are dealt to at most.
COMPARE_TASKS = 4096
#: Words whose hashes a worker keeps; contents that a task holds before it passes them on; how often a task sees a content before it is joined there.
MEMO_WORDS, HELD_ROWS, LOCAL = 500_000, 1_500_000, 8
#: Ids that are broadcast to pick the texts whose n-grams are compared; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Sets of a content up to which its pairs are listed before sets are put into families; of more, all fall into one.
PAIRED = 256
#: Low bits of a content's hash: 1 on odd levels, 2 for the content that all sets of a class have that no order cuts
#: well, 3 for a mark that no one meets by: of sets that no order cuts into more fragments than any of the class can differ in.
_FLAGS = np.uint64(3)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)  # fixed values: odd multipliers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int) -> np.ndarray:
    """n different odd multipliers."""
    more = np.arange(len(_ODD), max(n, len(_ODD)), dtype=np.uint64)
    return np.concatenate((_ODD, mix(more + _ODD[0]) | np.uint64(1)))[:n]


class WordHashes(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()
_hash_of = _hashes.__getitem__


def forget() -> None:
    """At a task's end: the worker holds neither words nor free memory until its next task."""
    _hashes.clear()
    give_back()


class Sets:
    """The n-gram sets of some texts: sorted distinct hashes, one set after the other."""

    def __init__(self, texts: list[str | None], width: int):
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        h = np.fromiter(map(_hash_of, chain.from_iterable(split)), np.uint64, int(lengths.sum()))
        grams = np.full(max(len(h) - width + 1, 0), width, np.uint64)
        factors = odd(width)
        for k in range(width):
            grams += h[k : k + len(grams)] * factors[k]
        grams = mix(grams)
        parts, at = [], 0
        for n in lengths.tolist():
            if n >= width:
                one = np.sort(grams[at : at + n - width + 1])
                parts.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
            elif n:  # the whole sequence as one
                parts.append(mix(np.array([n], np.uint64) + (h[at : at + n] * factors[:n]).sum(dtype=np.uint64)))
            else:
                parts.append(grams[:0])
            at += n
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.grams = np.concatenate(parts) if parts else grams
        self.start = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if parts else np.zeros(0, np.int64)
        self.some = np.flatnonzero(self.sizes)  # the texts that have words

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each set that isn't empty."""
        first = self.start[self.some]
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = [np.add.reduceat(mix(self.grams ^ x), first) for x in _ODD[:2]]
        size = self.sizes[self.some].astype(np.uint64)
        return mix(sums[0] + size * _ODD[2]).view(np.int64), mix(sums[1] + size * _ODD[3]).view(np.int64)

    def nodes(self, clashes: frozenset[int] = frozenset()) -> np.ndarray:
        """The identity of each set that isn't empty: its first hash, or its second one where different sets have one first."""
        name, other = self.names()
        return np.where(np.isin(name, list(clashes)), other, name) if clashes else name

    def of(self, i: int) -> np.ndarray:
        return self.grams[self.start[i] : self.start[i] + self.sizes[i]]


class Cuts:
    """Size classes and numbers of fragments for one threshold.

    A class spans sizes up to 1 / threshold ** WIDTH apart: wider ones need more fragments, narrower ones more sets that
    reach into the next class.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]

    def limit(self, k: int) -> int:
        """The least size of class k."""
        while len(self.bounds) <= k:
            last = self.bounds[-1]
            for _ in range(WIDTH):
                last = max(last + 1, -(-last * self.den // self.num))
            self.bounds.append(last)
        return self.bounds[k]

    def class_of(self, size: int) -> int:
        k = 0
        while self.limit(k + 1) <= size:
            k += 1
        return k

    def reaches(self, size: int) -> bool:
        """Whether a set of this size can be linked with one of the next class."""
        return size * self.den >= self.limit(self.class_of(size) + 1) * self.num

    def differ(self, k: int) -> int:
        """The most n-grams in which two linked sets that meet on level k can differ."""
        both = 2 * (self.limit(k + 1) - 1)
        return both * (self.den - self.num) // (self.den + self.num)

    def fragments(self, k: int) -> int:
        """More than can differ, by MARGIN: so linked sets have a share of their fragments in common."""
        h = self.differ(k)
        return h + 2 + -(-h * MARGIN // 100) if h else 0

    def differs(self, size: int) -> tuple[int, int]:
        """The most n-grams in which a linked set can differ from one of this size, on the level of its class and the next."""
        most = size * self.den // self.num
        own, above = ((size + partner) * (self.den - self.num) // (self.den + self.num) for partner in (min(most, self.limit(self.class_of(size) + 1) - 1), most))
        return own, above

    def alike(self, size: int) -> tuple[int, int]:
        """The fragments that a linked set has in common at least, on its level that is even and on that which is odd."""
        k = self.class_of(size)
        own, above = (max(1, self.differ(k + up) + 1 - h) for up, h in enumerate(self.differs(size)))
        return (above, own) if k & 1 else (own, above)


def contents(sets: Sets, chosen: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the chosen sets' fragments on the level of their class and, where they reach it, the next; each one's place in chosen."""
    sizes = sets.sizes[chosen]
    own = np.array([cuts.class_of(int(n)) for n in sizes], np.int64)
    flat = np.concatenate([sets.of(i) for i in chosen.tolist()]) if len(chosen) else sets.grams[:0]
    out, owner = [], []
    for up in (0, 1):
        level = own + up
        m = np.array([cuts.fragments(int(k)) for k in level], np.uint64)
        h = np.array([cuts.differ(int(k)) for k in level], np.int64)
        most = np.zeros(len(chosen), np.int64)
        if up:
            m *= np.array([cuts.reaches(int(n)) for n in sizes], np.uint64)
        left = np.flatnonzero(m)  # linked sets of the others are equal
        for order in range(ORDERS):
            if not len(left):
                break
            keep = np.isin(np.arange(len(chosen)), left)
            who = np.repeat(np.arange(len(chosen)), sizes)
            key, who = flat[keep[who]], who[keep[who]]
            if order:
                key = mix(key + _ODD[3] * np.uint64(order))
                by = np.lexsort((key, who))
                key, who = key[by], who[by]
            place = ((key >> np.uint64(32)) * m[who]) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (who[1:] != who[:-1]))))
            sums = np.add.reduceat(mix(key ^ _ODD[4]), first)
            lead = who[first]
            h64 = mix(sums + place[first] * _ODD[5] + (level[lead] * 16 + order).astype(np.uint64) * _ODD[6])
            out.append((h64 & ~_FLAGS) | (level[lead] & 1).astype(np.uint64))
            owner.append(lead)
            filled = np.bincount(lead, minlength=len(chosen))
            most = np.maximum(most, filled)
            left = left[filled[left] <= h[left]]
        own_h = np.array([cuts.differs(int(n))[up] for n in sizes[left]], np.int64)
        for some, flag in ((left[most[left] <= own_h], 2), (left, 3)):
            out.append((mix((level[some] * 16 + 15).astype(np.uint64) * _ODD[7]) & ~_FLAGS) | np.uint64(flag))
            owner.append(some)
    return (np.concatenate(out), np.concatenate(owner)) if out else (sets.grams[:0], np.zeros(0, np.int64))


def needs(sets: Sets, cuts: Cuts) -> np.ndarray:
    """The contents that a linked set has in common with each set that isn't empty, at least: on even levels, on odd ones.

    That is the fragments of the first order, which every set has the contents of, less those that can differ.
    """
    out = np.ones((2, len(sets.some)), np.int64)
    for x, i in enumerate(sets.some.tolist()):
        size = int(sets.sizes[i])
        k = cuts.class_of(size)
        for up, h in enumerate(cuts.differs(size)):
            if (m := cuts.fragments(k + up)) and (not up or cuts.reaches(size)):
                place = ((sets.of(i) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                out[(k + up) & 1, x] = max(1, 1 + np.count_nonzero(place[1:] != place[:-1]) - h)
    return out


POSTS = "content long, node long, pivot long"


def _starred(content: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: contents that occur LOCAL times or more are joined to their first node here (pivot; its own row's too)."""
    order = np.argsort(content, kind="stable")
    sorted_ = content[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(content) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(content)))
    pivot, local = np.empty_like(node), np.empty(len(node), bool)  # rows stay by set, which packs well
    pivot[order] = np.repeat(node[order[first]], sizes)
    local[order] = np.repeat(sizes, sizes) >= LOCAL
    return pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array(node), pa.array(pivot, mask=~local)], names=["content", "node", "pivot"])


def ngram_components(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, n_shingles (set size), component_id (least id reachable by links, itself included).

    Two rows link when den * intersection >= num * union of their n-gram sets. Words are what ASCII white space
    parts, lower-cased in ASCII; a text of fewer than `width` words has one n-gram, all of them. A null or empty text
    has no n-gram and links with nothing. Rows that repeat a text or an id are rows of their own; ids that are null are
    never a component's least unless all are. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "ngram-join")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            sets = Sets(batch.column(1).to_pylist(), width)
            names = np.zeros((2, len(sets.sizes)), np.int64)
            names[:, sets.some] = sets.names()
            row = np.arange(at, at + len(sets.sizes))
            at += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(row), pa.array(sets.sizes), *(pa.array(x, mask=sets.sizes == 0) for x in names)], names=["id", "row", "n", "node", "other"])
        forget()

    @F.pandas_udf("alike_even long, alike_odd long")
    def alike(n):
        import pandas as pd

        cuts = Cuts(num, den)
        return pd.DataFrame([cuts.alike(x) for x in n.tolist()], columns=["alike_even", "alike_odd"], dtype="int64")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, seen, held, count = Cuts(num, den), set(), [], 0
        for batch in batches:
            sets = Sets(batch.column(0).to_pylist(), width)
            nodes = sets.nodes(clashes)
            fresh = []
            for at, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(at)
            nodes, chosen = nodes[fresh], sets.some[fresh]
            found, owner = contents(sets, chosen, cuts)
            held.append((found, nodes[owner]))
            count += len(found)
            if count > HELD_ROWS:
                yield _starred(*map(np.concatenate, zip(*held, strict=True)))
                seen, held, count = set(), [], 0
        if held:
            yield _starred(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
        seen.clear()
        forget()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by content, those whose content has two nodes or more."""
        last = None  # content, node of the row that leads the last batch's last group, and whether it has been given out
        for batch in batches:
            c, x, starred = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            local = starred & (batch.column(2).fill_null(0).to_numpy() != x)
            out = [(c[local], x[local])]
            c, x, met = c[~local], x[~local], starred[~local]  # met: a pivot, whose others are local rows elsewhere
            if len(c):
                if last is not None:
                    c, x, met = np.append(last[0], c), np.append(last[1], x), np.append(False, met)
                first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                other = x != np.repeat(x[first], np.diff(np.append(first, len(c))))
                shared = np.maximum.reduceat(other | met, first)
                lead = np.zeros(len(c), bool)
                lead[first] = shared  # a group's first row goes out with its first other one or pivot
                if last is not None and last[2]:
                    lead[0] = False
                out.append((c[other | lead], x[other | lead]))
                given = bool(shared[-1]) or (len(first) == 1 and last is not None and last[2])
                last = (c[first[-1]], x[first[-1]], given)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*out, strict=True)], names=["content", "node"])

    sets = ws.stage(rows.mapInArrow(measure, f"id {kind}, row long, n long, node long, other long"), "sets")
    # Different sets with one hash of 64 bits (a few at 10^10 documents) go by their other hash.
    with_words = sets.filter("node is not null")
    clashes = frozenset(r.node for r in with_words.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y").collect())
    if clashes:
        sets = sets.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("other")).otherwise(F.col("node")))
        with_words = sets.filter("node is not null")
    each = with_words.groupBy("node").agg(F.first("n").alias("size"), F.min("id").alias("id"), F.count("*").alias("copies"))
    each = ws.stage(each.select("node", "id", "copies", alike("size").alias("a")).select("node", "id", "copies", "a.*"), "each")
    salt = F.when(F.col("pivot").isNull() | (F.col("pivot") == F.col("node")), 0).otherwise(1 + F.pmod(F.xxhash64("node"), F.lit(1000))).cast("int")
    posts = rows.select("text").mapInArrow(post, POSTS).repartition(F.col("content"), salt).sortWithinPartitions("content", "node")
    lists = ws.stage(posts.mapInArrow(meet, "content long, node long"), "lists")
    ws.release()

    # A fragment that no other set has differs from any partner's: sets with too few others are linked with none.
    flag = F.col("content").bitwiseAND(F.lit(3))
    met = lists.groupBy("node").agg(F.count_if(flag == 0).alias("even"), F.count_if(flag == 1).alias("odd"), F.count_if(flag == 2).alias("free"), F.count_if(flag == 3).alias("marked"))
    nodes = ws.stage(met.join(each, "node").filter("even >= alike_even or odd >= alike_odd or free > 0 or marked > 0 and even + odd > 0").select("node", "id"), "nodes")
    chosen = nodes.select("id").distinct()
    if nodes.count() <= BROADCAST_IDS:  # else the texts are shuffled by id
        chosen = F.broadcast(chosen)
    nodes = nodes.select("node")
    lists = lists.filter(flag != 3).join(nodes, "node", "left_semi")

    # The n-grams of the nodes that meet others, by fragment of the order.

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(num, den)
        for batch in batches:
            sets = Sets(batch.column(0).to_pylist(), width)
            node, part, grams = [], [], []
            for i, me in zip(sets.some.tolist(), sets.nodes(clashes).tolist(), strict=True):
                found = sets.of(i)
                edge = np.searchsorted(((found >> np.uint64(32)) * np.uint64(PARTS)) >> np.uint64(32), np.arange(PARTS + 1, dtype=np.uint64))
                for p in range(PARTS):
                    node.append(me)
                    part.append(p)
                    grams.append(found[edge[p] : edge[p + 1]].view(np.int64))
            size = np.repeat(sets.sizes[sets.some], PARTS)
            need = np.repeat(needs(sets, cuts), PARTS, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.list_(pa.int64())), *(pa.array(x, pa.int32()) for x in (size, *need))], names=["node", "part", "grams", "n", "need_even", "need_odd"])
        forget()

    spelt = rows.join(chosen, rows.id.eqNullSafe(chosen.id), "left_semi").select("text").mapInArrow(spell, "node long, part int, grams array<long>, n int, need_even int, need_odd int")
    spelt = ws.stage(spelt.join(nodes, "node", "left_semi").dropDuplicates(["node", "part"]), "spelt")
    ws.release()

    def overlaps(pairs: DataFrame) -> DataFrame:
        """a, b, linked of distinct pairs: partial overlaps by fragment, summed."""
        left = spelt.select(F.col("node").alias("a"), "part", F.col("grams").alias("x"), F.col("n").alias("na"))
        right = spelt.select(F.col("node").alias("b"), "part", F.col("grams").alias("y"), F.col("n").alias("nb"))
        partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
        summed = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        return summed.select("a", "b", (F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).alias("linked"))

    # n-grams that no other of these sets has can't be common to any pair: they bound what can. (By 32 bits of the hash: a
    # clash counts one as shared, which keeps the bound.) What is left of a set is its share in common.
    grams = spelt.select("node", F.explode("grams").alias("g")).select("node", F.shiftright("g", 32).cast("int").alias("g")).repartition("g")
    own = grams.groupBy("g").agg(F.count("*").alias("sets"), F.min("node").alias("node")).filter("sets = 1").groupBy("node").agg(F.count("*").alias("own"))
    able_nodes = spelt.filter("part = 0").select("node", "n", "need_even", "need_odd").join(own, "node", "left").select("node", "n", "need_even", "need_odd", (F.col("n") - F.coalesce("own", F.lit(0))).cast("int").alias("common"))
    able_nodes = ws.stage(able_nodes.filter(F.col("common") * den >= F.col("n") * num), "able")
    need = F.when(flag == 0, F.col("need_even")).when(flag == 1, F.col("need_odd")).otherwise(1)
    members = ws.stage(lists.join(able_nodes, "node").select("content", "node", "n", "common", need.alias("need")), "members")
    ws.drop("lists")
    ws.release()

    def able(a: str, b: str, mine: str, its: str):
        """Whether two sets have enough n-grams that aren't theirs alone to be linked."""
        need = (F.col(a) + F.col(b)) * num
        return (F.col(mine) * (num + den) >= need) & (F.col(its) * (num + den) >= need)

    # Star: with the most central set of each content, that with the largest share in common.
    middle = members.groupBy("content").agg(F.max(F.struct((F.col("common") / F.col("n")).alias("share"), "node", "n", "common")).alias("m"), F.count("*").alias("sets")).filter("sets > 1")
    middle = middle.select("content", "sets", F.col("m.node").alias("pivot"), F.col("m.n").alias("pn"), F.col("m.common").alias("pc"))
    n = members.count()
    star = join_spread(members, ws.stage(middle, "middle"), ["content"], "sets", n, F.col("node")).filter((F.col("node") != F.col("pivot")) & able("n", "pn", "common", "pc")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    tested = ws.stage(overlaps(star), "tested")
    ws.release()
    component = ws.stage(connected_components(tested.filter("linked").select("a", "b"), ws), "first-components")

    # What is left: members of one content in different components, each without its most frequent contents but for as many
    # as make one of those that it has in common with a linked set stay. They fall into families (what pairs connect); sets
    # of one family are compared in tiles of bounded size, and only links leave a comparison.
    here = ws.stage(members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")), "here")
    ws.drop("members")

    def in_different(rows: DataFrame) -> DataFrame:
        """The contents of rows that sets of different components have."""
        return rows.groupBy("content").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("node").alias("lead"), F.count("*").alias("sets")).filter("x <> y").select("content", "lead", "sets")

    here = join_spread(here, ws.stage(in_different(here), "split"), ["content"], "sets", n, F.col("node")).drop("lead")
    level = Window.partitionBy("node", flag)
    here = here.withColumn("place", F.row_number().over(level.orderBy("sets", "content"))).withColumn("met", F.count("*").over(level)).filter("place <= met - need + 1")
    here = ws.stage(here.select("content", "node", "component", "n", "common"), "rare")
    ws.drop("here")
    n = here.count()
    here = ws.stage(join_spread(here, ws.stage(in_different(here), "rare-split"), ["content"], "sets", n, F.col("node")), "rare-here")
    few, many = here.filter(F.col("sets") <= PAIRED), here.filter(F.col("sets") > PAIRED)
    other = few.select("content", *(F.col(c).alias(f"{c}_") for c in ("node", "component", "n", "common")))
    pairs = few.join(other, "content").filter((F.col("node") < F.col("node_")) & (F.col("component") != F.col("component_")) & able("n", "n_", "common", "common_")).select(F.col("node").alias("a"), F.col("node_").alias("b"))
    pairs = pairs.union(many.select("node", "lead")).distinct()
    family = connected_components(pairs, ws, "families")
    left = ws.stage(family.select("node", F.col("component").alias("family")).join(here.select("node", "component", "n", "common").distinct(), "node"), "left")
    ws.release()
    more = ws.stage(_compare_families(left, spelt, num, den, ws), "more")
    ws.drop("spelt")
    ws.release()
    if more.limit(1).count():
        component = ws.stage(connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), ws, "all"), "components")

    placed = ws.stage(each.join(component, "node", "left").select("node", "id", "copies", F.coalesce("component", "node").alias("component")), "placed")
    least = ws.stage(placed.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("sets")), "least")
    n = placed.count()
    by_node = ws.stage(join_spread(placed, least, ["component"], "sets", n, F.col("node")).select("node", "copies", "component_id"), "by-node")
    found = join_spread(sets.filter("node is not null"), by_node, ["node"], "copies", n, F.col("row")).select("id", "n", "component_id")
    found = found.unionByName(sets.filter("node is null").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


LINKS = "a long, b long"


class Tile:
    """Some sets of one family: nodes, components, sizes, shares in common and sorted n-grams."""

    def __init__(self, t: pa.Table):
        self.node, self.component, self.n, self.common = (t[c].to_numpy() for c in ("node", "component", "n", "common"))
        grams = t["grams"].combine_chunks()
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        self.grams = grams.flatten().to_numpy().view(np.uint64)
        self.owner = np.repeat(np.arange(t.num_rows), np.diff(grams.offsets.to_numpy()))


def links_between(a: Tile, b: Tile, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links between sets of two tiles that are in different components.

    Overlaps are counted fragment by fragment of the order of the n-grams that both tiles have, and summed.
    """
    need = (a.n[:, None] + b.n[None]) * num
    open_ = (a.component[:, None] != b.component[None]) & (a.common[:, None] * (num + den) >= need) & (b.common[None] * (num + den) >= need)
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return []
    place_a, place_b = np.full(len(a.n), -1), np.full(len(b.n), -1)
    place_a[rows], place_b[columns] = np.arange(len(rows)), np.arange(len(columns))
    keep_a, keep_b = place_a[a.owner] >= 0, place_b[b.owner] >= 0
    shared = np.intersect1d(a.grams[keep_a], b.grams[keep_b])
    overlap = np.zeros((len(rows), len(columns)), np.float32)
    sides = []
    for t, keep, place in ((a, keep_a, place_a), (b, keep_b, place_b)):
        at = np.searchsorted(shared, t.grams[keep])
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == t.grams[keep][hit]
        at, who = at[hit], place[t.owner[keep]][hit]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], who[order]))
    for low in range(0, len(shared), FRAGMENT):
        parts = []
        for (at, who), height in zip(sides, (len(rows), len(columns)), strict=True):
            x, y = np.searchsorted(at, (low, low + FRAGMENT))
            part = np.zeros((height, min(FRAGMENT, len(shared) - low)), np.float32)
            part[who[x:y], at[x:y] - low] = 1
            parts.append(part)
        overlap += parts[0] @ parts[1].T
    both = (a.n[rows][:, None] + b.n[columns][None]) - overlap
    i, j = np.nonzero(open_[np.ix_(rows, columns)] & (overlap * den >= both * num))
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up] if up in top else up
        return x

    out = []
    for x, y in zip(a.node[rows[i]].tolist(), b.node[columns[j]].tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            top[u] = v
            out.append((x, y))
    return out


def _compare_families(left: DataFrame, spelt: DataFrame, num: int, den: int, ws: Workspace) -> DataFrame:
    """Links (a, b) between the sets of left that are of one family and in different components."""
    grams = spelt.join(left.select("node"), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("part", "grams"))).alias("g"))  # PARTS rows each
    sizes = left.groupBy("family", "component").agg(F.sum(F.col("n") + SET_COST).alias("size"), F.count("*").alias("sets"))
    # Components beyond a tile have tiles of their own (block), which aren't compared with each other.
    own = F.col("size") > TILE_GRAMS
    sizes = ws.stage(sizes.withColumn("own", own).withColumn("block", F.when(own, F.col("component")).otherwise(0)), "family-sizes")
    blocks = sizes.groupBy("family", "own", "block").agg(F.sum("size").alias("block_size"), F.sum("sets").alias("block_sets"))
    families = sizes.groupBy("family").agg(F.sum("size").alias("size"))
    n = left.count()
    rows = join_spread(left, sizes.drop("size"), ["family", "component"], "sets", n, F.col("node")).drop("sets")
    rows = join_spread(rows, ws.stage(blocks.join(families, "family"), "blocks"), ["family", "own", "block"], "block_sets", n, F.col("node"))
    rows = rows.join(grams.select("node", F.flatten("g.grams").alias("grams")), "node").select("family", "size", "own", "block", "block_size", "node", "component", F.col("n").cast("long").alias("n"), F.col("common").cast("long").alias("common"), "grams")
    rows = ws.stage(rows, "family-rows")
    result = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def table(links: list[tuple[int, int]]) -> pa.Table:
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=result)

    def within(group: pa.Table) -> pa.Table:
        """Families that are one tile, some of them together."""
        group = group.sort_by("family")
        family = group["family"].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1], [True])))
        out = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            tile = Tile(group.slice(x, y - x))
            out += links_between(tile, tile, num, den)
        return table(out)

    total, largest = families.agg(F.coalesce(F.sum(F.when(F.col("size") <= TILE_GRAMS, F.col("size"))), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    bucket = F.pmod(F.xxhash64("family"), F.lit(max(64, total // (4 * TILE_GRAMS)))).cast("int")  # some tiles' n-grams each
    small = rows.filter(F.col("size") <= TILE_GRAMS).drop("own", "block", "block_size").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(within, LINKS)

    if largest <= TILE_GRAMS:
        return small

    # Larger ones: tiles are files in the shared folder, and pairs of their names are dealt to tasks.
    sub = F.pmod(F.xxhash64("node"), F.ceil(F.col("block_size") / TILE_GRAMS).cast("long"))
    large = rows.filter(F.col("size") > TILE_GRAMS).withColumn("tile", F.concat_ws("_", F.col("own").cast("int"), "block", sub))
    large.select("family", "tile", "node", "component", "n", "common", "grams").repartition("family", "tile").write.partitionBy("family", "tile").parquet(f"{ws.path}/tiles")
    root = f"{ws.path}/tiles"
    names = ws.stage(large.select("family", "tile", F.when(F.col("own"), F.col("block")).alias("whole")).distinct(), "tile-names")
    pairs = names.join(names.select("family", F.col("tile").alias("other"), F.col("whole").alias("whole_")), "family").filter("tile <= other and not coalesce(whole = whole_, false)").select("family", "tile", "other")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (load_tile(f"{root}/family={family}/tile={k}") for k in (x, y))
                yield from table(links_between(a, b, num, den)).to_batches()

    # A pair's name is a few bytes and its comparison long: without a number, small partitions would become one task.
    spread = pairs.repartition(min(max(1, pairs.count()), COMPARE_TASKS), "family", "tile", "other").sortWithinPartitions("family", "tile", "other")
    return small.unionByName(spread.mapInArrow(between, LINKS))


@lru_cache(maxsize=4)
def load_tile(path: str) -> Tile:
    system, where = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(where)) if f.base_name.startswith("part-"))
    columns = ["node", "component", "n", "common", "grams"]
    return Tile(pa.concat_tables([pq.read_table(f, filesystem=system, columns=columns, partitioning=None) for f in files]))
