"""Bounded samples for the models that the driver fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import stored

#: Bytes of features that the driver receives at most; a text with more than a sixteenth is not learnt from.
MAX_BYTES = 128 << 20


def one_text(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, ...) with one row a doc_id, that of the smallest hash of its text; combined before the shuffle."""
    first = lambda c: F.min_by(c, F.xxhash64("text")).alias(c)
    return rows.where("text is not null").groupBy("doc_id").agg(*(first(c) for c in rows.columns if c != "doc_id"))


def bounded(rows: DataFrame, size: Column, limit: int = MAX_BYTES) -> DataFrame:
    """rows, of distinct doc_id, in the order of its hash as long as their sizes add up to limit at most."""
    rows = stored(rows, "sample")
    sizes = rows.select("doc_id", size.cast("long").alias("size")).where(F.col("size") <= limit // 16)
    running = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = sizes.withColumn("running", running).where(F.col("running") <= limit).select("doc_id")
    return rows.join(F.broadcast(ids), "doc_id")
