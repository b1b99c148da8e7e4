"""Source routing: which repositories and collections a question belongs to.

score = min(1, coverage * (1 + 0.5 * share of tokens in the label)), with coverage weighted by
idf = ln((N + 1) / (df + 1)) over the pool of N sources; a token counts if it is a substring of
a field, once for each source. All tokens of a question go over each source row in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import token_index as TI

README_CHARS, WEAK, RARE = 2000, 0.3, 0.95


def tokens_of(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", query.lower()) if 2 <= len(t) <= 64 and t not in T.ROUTING_STOPWORDS))


def scores(sources: DataFrame, query: str, label: Column, *fields: Column, also: Column | None = None) -> DataFrame:
    """sources with matched (array), label_hits and score. also: tokens of the query, as an array, that match for another reason."""
    words = tokens_of(query)
    own = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    every = F.lower(F.concat_ws("\n", label, *fields))
    inside = lambda t: every.contains(t) if also is None else every.contains(t) | F.coalesce(F.array_contains(also, t), F.lit(False))
    found = sources.withColumn("matched", F.filter(own, inside))
    found = found.withColumn("label_hits", F.size(F.filter("matched", lambda t: F.lower(label).contains(t))).cast("long"))
    if not words:
        return found.withColumn("score", F.lit(0.0))
    # One row of document frequencies for the whole pool.
    counts = found.agg(F.count("*").alias("n"), *(F.sum(F.array_contains("matched", w).cast("long")).alias(f"df{k}") for k, w in enumerate(words)))
    idf = [F.when(F.col(f"df{k}") <= 0, 0.0).otherwise(F.ln((F.col("n") + 1) / (F.col(f"df{k}") + 1))) for k in range(len(words))]
    weights = counts.select(F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*idf)).alias("idf"))
    total = F.aggregate(F.map_values("idf"), F.lit(0.0), lambda s, x: s + x)
    hit = F.aggregate(F.transform("matched", lambda t: F.col("idf")[t]), F.lit(0.0), lambda s, x: s + x)
    cover = F.when(total > 0, hit / total).otherwise(F.size("matched") / len(words))
    score = F.least(F.lit(1.0), cover * (1 + 0.5 * F.col("label_hits") / len(words)))
    return found.join(F.broadcast(weights)).withColumn("score", score)


def route_repositories(sources: DataFrame, query: str, k: int, label: str = "label", readme: str = "readme", symbols: str = "symbols") -> DataFrame:
    """Sources that match at all, best first."""
    scored = scores(sources, query, F.col(label), F.substring(readme, 1, README_CHARS), F.col(symbols))
    return scored.where(F.size("matched") > 0).orderBy(F.desc("score"), label).limit(k)


def body_matches(index: TI.TokenIndex, query: str, of: DataFrame, label: str = "label") -> DataFrame:
    """(label, in_body): for each collection, the tokens of the query that a document of it holds as a word, stemmed as the index is.
    of(id, label): the documents' collections. Reads the postings of these tokens only."""
    found = None
    for t in tokens_of(query):
        rows = TI.holding(index, t).select("id", F.lit(t).alias("token"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return of.select(label, F.array().cast("array<string>").alias("in_body")).limit(0)
    return found.join(of.select("id", label), "id").groupBy(label).agg(F.collect_set("token").alias("in_body"))  # no more than the query has


def route_collections(collections: DataFrame, query: str, k: int, label: str = "label", headings: str = "headings", bodies: DataFrame | None = None) -> DataFrame:
    """The best k collections, matching or not; ``weak`` below 0.3. bodies(label, in_body): see body_matches."""
    rows = collections.join(bodies, label, "left") if bodies is not None else collections
    scored = scores(rows, query, F.col(label), F.substring(headings, 1, 65536), also=F.col("in_body") if bodies is not None else None)
    return scored.withColumn("weak", F.col("score") < WEAK).orderBy(F.desc("score"), label).limit(k)


def explained(routed: DataFrame) -> DataFrame:
    """Up to four matched tokens in order, the rare ones marked."""
    most = F.array_max(F.transform("matched", lambda t: F.col("idf")[t]))
    mark = lambda t: F.when((F.col("idf")[t] > 0) & (F.col("idf")[t] >= RARE * most), F.concat(t, F.lit(" (rare)"))).otherwise(t)
    return routed.withColumn("why", F.array_join(F.transform(F.slice(F.array_sort("matched"), 1, 4), mark), ", "))


def pools(repositories: DataFrame, collections: DataFrame, query: str, k_repositories: int, k_collections: int, bodies: DataFrame | None = None, **columns: str) -> DataFrame:
    """(pool, label, score): both pools ranked by themselves, one after the other; columns as for route_repositories."""
    first = route_repositories(repositories, query, k_repositories, **columns).select(F.lit("repository").alias("pool"), F.col(columns.get("label", "label")).alias("label"), "score")
    return first.unionByName(route_collections(collections, query, k_collections, bodies=bodies).select(F.lit("collection").alias("pool"), "label", "score"))
