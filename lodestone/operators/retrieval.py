"""Retrieval streams, fusion and composition: each is a DataFrame -> DataFrame function.

Streams give (id, score) and are cut to ``cap`` rows before they are fused, which Spark runs as
a top-k per partition. Order ties always go to the id.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.functions.stem import english_stems, stem

RRF_K, CANDIDATE_CAP, RERANK_LEAST, RERANK_TOP = 60, 300, 50, 3
SIMILARITY, FALLBACK_SCORE = 0.3, 0.01
MOST_CONCEPTS = 1000
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def top(scored: DataFrame, k: int | None) -> DataFrame:
    """The k best rows; all of them, in no order, for None."""
    if k is None:
        return scored
    return scored.orderBy(F.desc("score"), "id").limit(k)


def vector_stream(vectors: DataFrame, query: list[float], k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact nearest rows by cosine; null vectors and those of another width are left out."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    usable = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    return top(usable.select(F.col(id).alias("id"), F.try_divide(V.dot_literal(F.col(vector), query), V.norm(F.col(vector)) * length).alias("score")), k)


def lexemes(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))


def matches_all(text: Column, words: list[str]) -> Column:
    """Has every word as a token; nothing matches an empty query."""
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(T.tokens(text), w)) if words else F.lit(False)


def occurrences(text: Column, words: list[str]) -> Column:
    """How often tokens of the text are among the words."""
    return F.size(F.filter(T.tokens(text), lambda t: t.isin(words))).cast("long")


def _cover_score(found: list[tuple[int, int, float]], n_words: int) -> float:
    """Sum over minimal covers of cpos / (1 + noise); found: (position, word, weight) by position."""
    total, low = 0.0, 0
    seen = [0] * n_words
    missing = n_words
    for high, (_, word, _) in enumerate(found):
        missing -= seen[word] == 0
        seen[word] += 1
        if missing:
            continue
        while seen[found[low][1]] > 1:
            seen[found[low][1]] -= 1
            low += 1
        inside = found[low : high + 1]
        noise = inside[-1][0] - inside[0][0] - (len(inside) - 1)
        total += len(inside) / sum(1 / w for _, _, w in inside) / (1 + max(noise, 0))
        seen[found[low][1]] -= 1
        missing += seen[found[low][1]] == 0
        low += 1
    return total


def cover_density(fields: dict[str, Column], words: list[str]) -> Column:
    """Cover-density rank of weighted fields' tokens, laid end to end in the order of their weights.

    Positions of the query's words are found in the JVM; only they are sent to Python.
    """

    @F.pandas_udf("double")
    def ranked(rows: pd.Series) -> pd.Series:
        return pd.Series([_cover_score([(int(p), int(w), f) for p, w, f in zip(*r, strict=True)], len(words)) for r in zip(rows["at"], rows["word"], rows["weight"], strict=True)])

    order = F.array(*map(F.lit, words))
    found, ahead = F.array().cast("array<struct<at:int,word:int,weight:double>>"), F.lit(0)
    for weight, column in fields.items():
        tokens = F.coalesce(column, F.array().cast("array<string>"))
        hits = F.filter(F.transform(tokens, lambda t, k: F.struct((k + ahead).alias("at"), (F.array_position(order, t) - 1).cast("int").alias("word"), F.lit(WEIGHTS[weight]).alias("weight"))), lambda x: x["word"] >= 0)  # noqa: B023
        found, ahead = F.concat(found, hits), ahead + F.size(tokens)
    one = lambda n: F.transform(found, lambda x: x[n]).alias(n)
    return ranked(F.struct(one("at"), one("word"), one("weight")))


def lexical_stream(docs: DataFrame, query: str, k: int | None, id: str = "doc_id", fields: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold every word of the query, by cover density. One word needs no covers: each
    occurrence is one, so the rank is a weighted count and stays in generated code."""
    words, fields = lexemes(query), fields or {"D": "text"}
    every = F.concat_ws(" ", *fields.values())
    hits = docs.where(matches_all(every, words))
    if len(words) == 1:
        score = sum((occurrences(F.coalesce(F.col(c), F.lit("")), words) * WEIGHTS[w] for w, c in fields.items()), F.lit(0.0))
    else:
        score = cover_density({w: T.tokens(F.col(c)) for w, c in fields.items()}, words)
    return top(hits.select(F.col(id).alias("id"), score.alias("score")), k)


def lexical_stream_english(docs: DataFrame, query: str, k: int | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same over English stems without function words; a query of function words only finds nothing."""
    words = list(dict.fromkeys(stem(w) for w in lexemes(query) if w not in T.ENGLISH_STOPWORDS))
    if not words:
        return top(docs.where(F.lit(False)).select(F.col(id).alias("id"), F.lit(0.0).alias("score")), k)
    # A stem keeps a word's first two letters (but for dying, lying, tying): texts without them are dropped before Python sees them.
    near = docs.where(F.forall(F.array(*(F.lit(w[:1] if w in ("die", "lie", "tie") else w[:2]) for w in words)), lambda w: F.lower(text).contains(w)))
    rows = near.select(F.col(id).alias("id"), english_stems(F.col(text)).alias("_t")).where(F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains("_t", w)))
    score = F.size(F.filter("_t", lambda t: t.isin(words))) * WEIGHTS["D"] if len(words) == 1 else cover_density({"D": F.col("_t")}, words)
    return top(rows.select("id", score.alias("score")), k)


def with_substring_fallback(docs: DataFrame, query: str, k: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The lexical stream, and rows that only hold the query as a substring, at a fixed score."""
    words = lexemes(query)
    matched = matches_all(F.col(text), words)
    exact = docs.where(matched).select(F.col(id).alias("id"), (occurrences(F.col(text), words) * 0.1).alias("score"))
    loose = docs.where(~matched & F.lower(text).contains(query.lower())).select(F.col(id).alias("id"), F.lit(FALLBACK_SCORE).alias("score"))
    return top(exact.unionByName(loose), k)


def symbol_stream(names: DataFrame, query: str, k: int, id: str, name: str, least: float = SIMILARITY) -> DataFrame:
    """Names of trigram similarity ``least`` or more."""
    scored = names.select(F.col(id).alias("id"), T.similarity(T.trigrams(F.col(name)), T.trigrams(F.lit(query))).alias("score"))
    return top(scored.where(F.col("score") >= least), k)


def ranked(stream: DataFrame, cap: int = CANDIDATE_CAP) -> DataFrame:
    """(id, score, rank): positions from 1. The window runs over ``cap`` rows at most."""
    return top(stream, cap).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")).cast("long"))


def fuse_scored(scored: DataFrame, names: tuple[str, ...], k: int = RRF_K, cap: int = CANDIDATE_CAP) -> DataFrame:
    """fuse() of streams that come as one table(stream, id, score), as when one scan scores several of them. Spark keeps
    ``cap`` rows a stream in each task before they meet."""
    rank = F.row_number().over(W.partitionBy("stream").orderBy(F.desc("score"), "id")).cast("long")
    placed = scored.select("stream", "id", "score").withColumn("rank", rank).where(F.col("rank") <= cap)
    return _fused(placed.select(F.col("id").cast("string").alias("id"), "stream", "rank"), names, k)


def fuse(streams: dict[str, DataFrame], k: int = RRF_K, cap: int = CANDIDATE_CAP) -> DataFrame:
    """Reciprocal rank fusion: (id, score, and a <name>_rank for each stream, 0 if not in it)."""
    parts = [ranked(s, cap).select(F.col("id").cast("string").alias("id"), F.lit(n).alias("stream"), "rank") for n, s in streams.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _fused(every, tuple(streams), k)


def _fused(every: DataFrame, names: tuple[str, ...], k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    ranks = [F.coalesce(F.min(F.when(F.col("stream") == n, F.col("rank"))), F.lit(0)).cast("long").alias(f"{n}_rank") for n in names]
    # Summed in rank order, so that equal sets of ranks give equal doubles.
    score = F.aggregate(F.array_sort(F.collect_list(F.col("rank"))), F.lit(0.0), lambda s, r: s + F.lit(1.0) / (r + k))
    return every.groupBy("id").agg(score.alias("score"), *ranks)


def rerank_wanted(candidates: DataFrame, query: str, name: str = "name", enabled: bool = True) -> DataFrame:
    """(wanted): whether a reranker is worth its cost for candidates(rank, name)."""
    last = F.lower(F.element_at(F.split(name, r"\."), -1))
    exact = F.max(((F.col("rank") <= RERANK_TOP) & (last == query.lower())).cast("int"))
    wanted = F.lit(enabled and bool(query.strip())) & (F.count("*") >= RERANK_LEAST) & (F.coalesce(exact, F.lit(0)) == 0)
    return candidates.agg(wanted.alias("wanted"))


def reranked(candidates: DataFrame, query: str, k: int, scorer: Callable[[Column, Column], Column] | None = None, content: str = "content") -> DataFrame:
    """The first ``k`` of candidates(id, score, content). Without a scorer they keep their order; with one, a function of
    the query and the content to a number such as a pandas UDF around a model, its value replaces the score and is kept
    as ``rerank_score``."""
    if scorer is None:
        return top(candidates, k).withColumn("rerank_score", F.lit(None).cast("double"))
    value = scorer(F.lit(query), F.col(content)).cast("double")
    return top(candidates.withColumn("rerank_score", value).withColumn("score", F.col("rerank_score")), k)


def symbol_exact(nodes: DataFrame, query: str, k: int, id: str, name: str, fields: dict[str, str]) -> DataFrame:
    """Names and words together: the lexical and the fuzzy stream, ``k`` of each, fused."""
    streams = {"lexical": lexical_stream(nodes, query, k, id, fields), "symbol": symbol_stream(nodes, query, k, id, name)}
    return fuse(streams, cap=k).orderBy(F.desc("score"), "id").limit(k)


def domain_rerank(hits: DataFrame, concepts: DataFrame, text: Column, gamma: float = 0.1) -> DataFrame:
    """score / max + gamma * min(1, highest importance of a concept that the text names).

    hits(id, score, ...), concepts(name, importance). Concepts are a short list, MOST_CONCEPTS at most (else this
    raises); each hit is met by every alias in one pass over a literal-sized table.
    """
    if concepts.limit(MOST_CONCEPTS + 1).count() > MOST_CONCEPTS:
        raise ValueError(f"more than {MOST_CONCEPTS} concepts")
    named = concepts.select(T.aliases(F.col("name")).alias("aliases"), "importance").agg(F.collect_list(F.struct("aliases", "importance")).alias("concepts"))
    low = F.lower(text)
    best = F.aggregate("concepts", F.lit(0.0), lambda m, c: F.greatest(m, F.when(F.exists(c["aliases"], lambda a: low.contains(a)), c["importance"]).otherwise(0.0)))
    joined = hits.join(F.broadcast(named))  # one row
    whole = F.max("score").over(W.partitionBy())
    return joined.withColumn("reranked", F.coalesce(F.try_divide(F.col("score"), whole), F.lit(0.0)) + gamma * F.least(F.lit(1.0), best)).drop("concepts")


def layers(hits: DataFrame, wanted: tuple[str, ...], k: int) -> DataFrame:
    """Rows for each hit's layers in fixed order, cut to k in fused order.

    hits(id, score, store, content, signature, summary); code hits give code, ast and
    ast_summary (if there is a summary), documents give repo_doc.
    """
    row = lambda n, name, body: F.struct(F.lit(n).alias("place"), F.lit(name).alias("layer"), body.alias("body"))
    of_code = F.array(row(0, "code", F.col("content")), row(1, "ast", F.col("signature")), row(2, "ast_summary", F.col("summary")))
    of_docs = F.array(row(3, "repo_doc", F.col("content")))
    emitted = F.filter(F.when(F.col("store") == "code", of_code).otherwise(of_docs), lambda x: x["layer"].isin(*wanted) & ((x["layer"] != "ast_summary") | x["body"].isNotNull()))
    out = hits.select("id", "score", F.explode(emitted).alias("e")).select("id", "score", "e.*")
    return out.orderBy(F.desc("score"), "id", "place").limit(k)
