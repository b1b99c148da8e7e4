"""Listings with a search box: documents, repositories, jobs, users; and the counts beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

JOB_LIMIT = 100


def holds(column: Column, query: str) -> Column:
    """The column holds the query literally, whatever the case; null holds nothing."""
    return F.coalesce(F.lower(column).contains(query.lower()), F.lit(False))


def documents(docs: DataFrame, query: str) -> DataFrame:
    """docs(path, title) whose path or title holds the query."""
    return docs.where(holds(F.col("path"), query) | holds(F.col("title"), query))


def repositories(repos: DataFrame, query: str, status: str | None = None) -> DataFrame:
    """repos(host, owner, name, git_url, status) of which a field holds the query."""
    found = repos.where(holds(F.col("host"), query) | holds(F.col("owner"), query) | holds(F.col("name"), query) | holds(F.col("git_url"), query))
    return found.where(F.col("status") == status) if status else found


def jobs(rows: DataFrame, repos: DataFrame, query: str | None = None) -> DataFrame:
    """Jobs(repo_id, kind, ...), those without a repository included; with a query, those whose kind or whose repository's name holds it.

    Repositories are joined only if there is a query.
    """
    if not query:
        return rows
    named = rows.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("_name")), "repo_id", "left")
    return named.where(holds(F.col("_name"), query) | holds(F.col("kind"), query)).drop("_name")


def visible_jobs(rows: DataFrame, collections: DataFrame, user, role: str | None = None, status: str | None = None, limit: int = JOB_LIMIT) -> DataFrame:
    """(id, collection, status, created_at) of the newest jobs whose collection the caller owns or that is public; admins see all
    (owners are no admins here)."""
    seen = collections if role == "admin" else collections.where((F.col("owner") == user) | (F.col("visibility") == "public"))
    out = rows.join(seen.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id")
    out = out.where(F.col("status") == status) if status else out
    return out.select("id", "collection", "status", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_usage(users: DataFrame) -> DataFrame:
    """users(email, query_count) in the order of their use, with ``place`` in it."""
    place = F.row_number().over(W.orderBy(F.desc("query_count"), F.lower("email"), "email")).cast("long")
    return users.withColumn("place", place)


def first_readme(files: DataFrame, names: tuple[str, ...] = ("readme.md", "readme.rst", "readme.txt", "readme")) -> DataFrame:
    """(repo, path) of each repository's README: the first of the names, then the shortest path, then by path."""
    last = F.lower(F.element_at(F.split("path", "/"), -1))
    place = F.array_position(F.array(*map(F.lit, names)), last)
    order = F.row_number().over(W.partitionBy("repo").orderBy("_at", F.size(F.split("path", "/")), "path"))
    return files.withColumn("_at", place).where("_at > 0").withColumn("_n", order).where("_n = 1").select("repo", "path")


def mention_counts(chunks: DataFrame, key: str, mentions: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.coalesce(F.sum(F.greatest(F.size(mentions), F.lit(0))), F.lit(0)).cast("long").alias("mentions"))


def group_counts(groups: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """(group_id, members, grants) of every group, those without any included."""
    count = lambda rows, name: rows.groupBy("group_id").agg(F.count("*").alias(name))
    return groups.select("group_id").distinct().join(count(members, "members"), "group_id", "left").join(count(grants, "grants"), "group_id", "left").na.fill(0, ["members", "grants"])


def last_admins(users: DataFrame, demoted: DataFrame) -> DataFrame:
    """(none_left): whether no active admin of users(id, role, active) is left once demoted(id) are none."""
    left = users.where("role in ('admin', 'owner') and active").join(demoted.select("id"), "id", "left_anti")
    return left.agg((F.count("*") == 0).alias("none_left"))


def unresolved_counts(links: DataFrame, key: str, target: str) -> DataFrame:
    return links.groupBy(key).agg(F.count_if(F.col(target).isNull()).alias("unresolved"))


def summarised(nodes: DataFrame, embeddings: DataFrame, summaries: DataFrame) -> DataFrame:
    """Nodes that have an embedding, with their summary if there is one."""
    return nodes.join(embeddings.select("id", "embedding"), "id").join(summaries.select("id", "summary"), "id", "left")


def linked_documents(hits: DataFrame, mentions: DataFrame, chunks: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """(node_id, doc_id, path, place): of hits(node_id) the documents whose chunks mention them, ``most`` each, the most mentions first."""
    rows = mentions.join(hits.select("node_id").distinct(), "node_id", "left_semi").join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(docs.select("doc_id", "path"), "doc_id")
    counted = rows.groupBy("node_id", "doc_id", "path").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("n"), "doc_id")).cast("long")
    return counted.withColumn("place", place).where(F.col("place") <= most).select("node_id", "doc_id", "path", "place")


def group_sources(members: DataFrame, groups: DataFrame, providers: DataFrame) -> DataFrame:
    """(user_id, group_name, source, provider): one row a user and group, synchronised ones first; the provider's name if known."""
    rows = members.join(groups.select("group_id", F.col("name").alias("group_name")), "group_id").join(providers.select("provider_id", F.col("name").alias("provider")), "provider_id", "left")
    first = F.row_number().over(W.partitionBy("user_id", "group_id").orderBy(F.when(F.col("source") == "oidc", 0).otherwise(1), "provider"))
    return rows.withColumn("_n", first).where("_n = 1").select("user_id", "group_name", "source", "provider")
