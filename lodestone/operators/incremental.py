"""Incremental maintenance over plain tables: compare, merge, prune, and say why a page is stale.

A table without transactions is changed by computing its next version from the last: every
function returns the rows of the new version, or rows with an ``action`` column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def diff(old: DataFrame, new: DataFrame, keys: list[str], hash: str) -> DataFrame:
    """(keys, action): insert, delete, update or keep, by a null-safe comparison of ``hash``."""
    a = old.select(*keys, F.col(hash).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(hash).alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], id: str, hash: str) -> DataFrame:
    """The next version: new rows, which keep the old ``id`` where keys match; rows gone are deleted."""
    kept = old.select(*keys, F.col(id).alias("_id"), F.col(hash).alias("_hash"))
    joined = new.join(kept, keys, "left")
    action = F.when(F.col("_id").isNull(), "insert").when(F.col("_hash").eqNullSafe(F.col(hash)), "keep").otherwise("update")
    return joined.withColumn("action", action).withColumn(id, F.coalesce("_id", id)).drop("_id", "_hash")


def changed(old: DataFrame, new: DataFrame, keys: list[str], hash: str) -> DataFrame:
    """Rows of new that must be processed: unknown, or of another hash."""
    return new.join(old.select(*keys, F.col(hash).alias("_hash")), keys, "left").where(~F.col(hash).eqNullSafe(F.col("_hash"))).drop("_hash")


def prune(rows: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner in keep go; a null key is an orphan."""
    return rows.join(keep.select(*keys).distinct(), keys, "left_semi")


def orphans(rows: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(keep.select(*keys), keys, "left_anti")


def touches(changes: DataFrame, key: str, order: str, kind: str, old_key: str, columns: list[str]) -> DataFrame:
    """(key, order, alive, row): what changes say of single keys. Kinds A, M, D, R (old_key -> key); C counts as A, T as M. A rename
    touches two keys: the old one is gone from then on, the new one is there."""
    row = F.struct(*columns)
    alive = F.col(kind).isin("A", "M", "R", "C", "T")
    own = changes.select(F.col(key).alias("key"), F.col(order).alias("order"), alive.alias("alive"), F.when(alive, row).alias("row"))
    left = changes.where((F.col(kind) == "R") & F.col(old_key).isNotNull()).select(F.col(old_key).alias("key"), F.col(order).alias("order"), F.lit(False).alias("alive"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    return own.unionByName(left)


def last_touches(found: DataFrame) -> DataFrame:
    """Of each key the touch of highest order (the living one of two with the same). Any grouping or repetition of
    touches before gives the same rows, so they may come in any order, in parts, and more than once."""
    last = F.max_by(F.struct("order", "alive", "row"), F.struct("order", "alive"))
    return found.groupBy("key").agg(last.alias("t")).select("key", "t.order", "t.alive", "t.row")


def with_touches(table: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """The table after the last touch of each key."""
    stay = table.join(last.select(F.col("key").alias(key)), key, "left_anti")
    return stay.select(*table.columns).unionByName(last.where("alive").select("row.*").select(*table.columns))


def apply_changes(table: DataFrame, changes: DataFrame, key: str, order: str, kind: str, old_key: str) -> DataFrame:
    """The table after a change feed in the order of ``order``: a key is there with the row of its last change, unless that deletes it or
    renames it away. Names may be taken again and rename chains have any length."""
    return with_touches(table, last_touches(touches(changes, key, order, kind, old_key, table.columns)), key)


def needs_full_walk(changes: DataFrame, root: str = "go.mod", failed: bool = False) -> DataFrame:
    """(full): whether a change feed(path, old_path) touches the root module file. A feed without rows means that nothing changed;
    one that couldn't be read (``failed``) asks for a full walk whatever rows it has."""
    touched = F.bool_or(F.coalesce(F.col("path") == root, F.lit(False)) | F.coalesce(F.col("old_path") == root, F.lit(False)))
    return changes.agg((F.coalesce(touched, F.lit(False)) | F.lit(failed)).alias("full"))


def plan_changes(changes: DataFrame) -> DataFrame:
    """(path, step): what a change feed(kind, path, old_path) asks for, deletions before insertions: a rename deletes the old path
    and adds the new one, also where the language changes with it."""
    gone = changes.where("kind = 'D'").select("path").union(changes.where("kind = 'R'").select("old_path")).select("path", F.lit("1-delete").alias("step"))
    return gone.union(changes.where("kind != 'D'").select("path", F.lit("2-ingest").alias("step"))).distinct()


def replace_children(children: DataFrame, new: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """children (chunks, links) after the documents(key, action) were merged: those of deleted and updated ones go, and the new ones
    of inserted and updated ones come; those of kept documents stay."""
    of = lambda *a: documents.where(F.col("action").isin(*a)).select(key)
    return children.join(of("delete", "update"), key, "left_anti").unionByName(new.join(of("insert", "update"), key, "left_semi"))


def embed_again(rows: DataFrame, stored: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Rows whose stored stamps differ in any part, null-safe."""
    stamps = stored.select(key, *(F.col(p).alias(f"_{p}") for p in parts), F.lit(True).alias("_known"))
    same = reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts))
    return rows.join(stamps, key, "left").where(F.col("_known").isNull() | ~same).select(*rows.columns)


def peers_to_refresh(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """Nodes with an edge to or from a doomed one, and not doomed themselves."""
    ids = doomed.select("id").distinct()
    out = edges.join(ids, edges["src"] == ids["id"], "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(ids, edges["dst"] == ids["id"], "left_semi").select(F.col("src").alias("id"))
    return out.union(back).where("id is not null").distinct().join(ids, "id", "left_anti")


def dirty_reason(known: Column, version: Column, current_version: int, spec: Column, current_spec: Column, quality: Column, nodes_missing: Column, chunks_missing: Column, nodes_changed: Column, cited: Column, current_cited: Column) -> Column:
    """The first reason to write a page again, null if none; a null stamp of what it cites is adopted."""
    return (
        F.when(~known, "missing_row").when(~version.eqNullSafe(F.lit(current_version)), "schema_version").when(~spec.eqNullSafe(current_spec), "spec_changed")
        .when(quality.isNull(), "quality_unknown").when(quality == "degraded", "quality_degraded")
        .when(nodes_missing > 0, "cited_node_missing").when(chunks_missing > 0, "cited_chunk_missing").when(nodes_changed > 0, "cited_node_content_changed")
        .when(cited.isNotNull() & ~cited.eqNullSafe(current_cited), "cited_evidence_changed")
    )


def citation_state(citations: DataFrame, live: DataFrame, page: str, id: str, hash: str) -> DataFrame:
    """(page, cited, missing, changed, fingerprint) of citations(page, id, hash) against live(id, hash)."""
    joined = citations.join(live.select(id, F.col(hash).alias("_live"), F.lit(True).alias("_is")), id, "left")
    stamp = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", id, "_live"))), "\n"), 256)
    return joined.groupBy(page).agg(F.count("*").alias("cited"), F.count_if(F.col("_is").isNull()).alias("missing"), F.count_if(F.col("_is") & ~F.col("_live").eqNullSafe(F.col(hash))).alias("changed"), stamp.alias("fingerprint"))


QUALITY = ("degraded", "partial", "ok")  # worst first


def quality_upsert(old: DataFrame, new: DataFrame, key: str, hash: str, quality: str) -> DataFrame:
    """new with ``action``: insert; touch (same content); keep (it would be worse); else write."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, QUALITY)), c)
    joined = new.join(old.select(key, F.col(hash).alias("_hash"), F.col(quality).alias("_quality")), key, "left")
    action = F.when(F.col("_hash").isNull(), "insert").when(F.col("_hash") == F.col(hash), "touch").when(F.coalesce(rank(F.col(quality)), F.lit(0)) < F.coalesce(rank(F.col("_quality")), F.lit(0)), "keep").otherwise("write")
    return joined.withColumn("action", action).drop("_hash", "_quality")


def edit_streak(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """(key, streak): edits since the last full write."""
    since = F.max(F.when(F.col(kind) == "write", F.col(order))).over(W.partitionBy(key))
    return events.withColumn("_since", since).groupBy(key).agg(F.count_if((F.col(kind) == "edit") & (F.col("_since").isNull() | (F.col(order) > F.col("_since")))).alias("streak"))


def purge(tables: dict[str, DataFrame], doomed: DataFrame, foreign: dict[str, str], key: str) -> dict[str, DataFrame]:
    """Every table without the rows of doomed owners."""
    return {n: t.join(doomed.select(F.col(key).alias(foreign[n])).distinct(), foreign[n], "left_anti") for n, t in tables.items()}
