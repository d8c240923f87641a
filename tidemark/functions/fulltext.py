"""Full-text search: natural language, BM25 and boolean mode, as relational plans."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relevance of an occurrence, weights of the signs of boolean mode, and the least relevance there.
BASE, WEIGHTS, FAINT = 0.22764469683170319, {"": 1.0, "+": 1.0, ">": 2.0, "<": 0.5}, 0.001
#: Least length of a token, and BM25's saturation and length normalisation.
LEAST, K1, B = 3, 1.2, 0.75
# Words that aren't searched for (the default list of the dialect).
STOP_WORDS = ("about", "are", "com", "for", "from", "how", "that", "the", "this", "was", "what", "when", "where", "who", "will", "with", "und", "www")


def tokens(text: Column) -> Column:
    """Lower-cased words of at least LEAST letters or digits, without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_']+")
    return F.filter(words, lambda w: (F.char_length(w) >= LEAST) & ~w.isin(*STOP_WORDS))


def query_tokens(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w']+", query.lower()) if len(w) >= LEAST and w not in STOP_WORDS})


def natural_score(text: Column, query: str) -> Column:
    """BASE for every occurrence of the query's words in the text."""
    found = tokens(text)
    wanted = query_tokens(query)
    return F.size(F.filter(found, lambda w: w.isin(*wanted))) * F.lit(BASE) if wanted else F.lit(0.0)


def search(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """Rows that hold a word of the query, with their score, most relevant first and ties by id.

    Texts without any of the words as a plain part of them are left out before they are split.
    """
    wanted = query_tokens(query)
    if not wanted:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    near = F.lower(F.col(text_col)).rlike("|".join(map(re.escape, wanted)))
    return df.filter(near).withColumn("score", natural_score(F.col(text_col), query)).filter("score > 0").orderBy(F.desc("score"), id_col)


def bm25(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """id and score of the rows with a word of the query; statistics over the whole table.

    Only the query's words are exploded, so what is shuffled is one row per document and word found.
    """
    wanted = query_tokens(query)
    docs = df.select(F.col(id_col), tokens(F.col(text_col)).alias("words")).withColumn("length", F.size("words"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = docs.select(id_col, "length", F.explode(F.filter("words", lambda w: w.isin(*wanted))).alias("word")).groupBy(id_col, "length", "word").agg(F.count("*").alias("tf"))
    spread = hits.groupBy("word").agg(F.count("*").alias("df"))  # one row per word of the query
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(spread), "word").crossJoin(F.broadcast(stats)).groupBy(id_col).agg(F.sum(weight).alias("score"))


def boolean_match(text: Column, query: str) -> Column:
    """AGAINST (query IN BOOLEAN MODE) as a condition: + must, - must not, * prefix, "phrase", ( ) groups; ~ > < only rank."""
    words, lowered = tokens(text), F.lower(F.coalesce(text, F.lit("")))
    parts = re.findall(r'[+\-~<>]*"[^"]*"|[+\-~<>]*\(|\)|[+\-~<>]*[\w\']+\*?', query.lower())

    def one(term: str) -> Column:
        if term.startswith('"'):
            return lowered.rlike(r"(?<![\p{L}\p{N}_])" + r"[^\p{L}\p{N}_]+".join(map(re.escape, re.findall(r"[\w']+", term))) + r"(?![\p{L}\p{N}_])")
        if term.endswith("*"):
            return F.exists(words, lambda w: w.startswith(term[:-1]))
        return F.array_contains(words, term)

    def group(at: int) -> tuple[Column, int]:
        must, never, may = [], [], []
        while at < len(parts) and parts[at] != ")":
            sign = re.match(r"[+\-~<>]*", parts[at])[0]
            term = parts[at][len(sign) :]
            if term == "(":
                found, at = group(at + 1)
            else:
                found = one(term)
            (must if "+" in sign else never if "-" in sign else may).append(found)
            at += 1
        out = F.lit(True)
        for c in must:
            out = out & c
        for c in never:
            out = out & ~c
        if may and not must:
            some = may[0]
            for c in may[1:]:
                some = some | c
            out = out & some
        elif not must:
            out = F.lit(False)
        return out, at

    return group(0)[0]


def boolean_score(text: Column, query: str) -> Column:
    """The relevance of AGAINST (query IN BOOLEAN MODE): the weighted sum of the terms that are there, 0 without a match.

    A word or a phrase counts 1, a prefix BASE an occurrence, a group its own relevance; > doubles and < halves. A ~
    term takes half of its relevance off, or adds BASE if it isn't there. All + terms must be there, no - term may,
    and without + terms one of the others (besides ~) must. The text is split once, and every term is a built-in
    expression over its words.
    """
    words, lowered = tokens(text), F.lower(F.coalesce(text, F.lit("")))
    parts = re.findall(r'[+\-~<>]*"[^"]*"|[+\-~<>]*\(|\)|[+\-~<>]*[\w\']+\*?', query.lower())
    zero = F.lit(0.0)

    def term_score(term: str) -> Column:
        if term.startswith('"'):
            return lowered.contains(term.strip('"')).cast("double")
        if term.endswith("*"):
            return F.size(F.filter(words, lambda w: w.startswith(term[:-1]))) * F.lit(BASE)
        return F.array_contains(words, term).cast("double")

    def group(at: int) -> tuple[Column, int]:
        clauses: list[tuple[str, Column]] = []
        while at < len(parts) and parts[at] != ")":
            signs = re.match(r"[+\-~<>]*", parts[at])[0]
            term = parts[at][len(signs) :]
            if term == "(":
                found, at = group(at + 1)
            else:
                found = term_score(term)
            clauses.append((signs[-1:], found))
            at += 1
        of = lambda signs: [x for sign, x in clauses if sign in signs]
        must, never, damped, may = of(("+",)), of(("-",)), of(("~",)), of(("", ">", "<"))
        total = sum((WEIGHTS[sign] * x for sign, x in clauses if sign in WEIGHTS), zero)
        total = sum((F.when(x > 0, -0.5 * x).otherwise(BASE) for x in damped), total)
        hit = reduce(and_, (x > 0 for x in must)) if must else reduce(or_, (x > 0 for x in may), F.lit(False))
        hit = reduce(and_, (x <= 0 for x in never), hit)
        return F.when(hit, F.greatest(total, F.lit(FAINT))).otherwise(zero), at

    return group(0)[0]
