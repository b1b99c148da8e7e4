"""A change feed as a stream: a table that follows it, kept as parts by micro-batch.

Each micro-batch is reduced to the last touch of every key (``incremental.last_touches``) and written to a folder of its batch
id, so a batch that is played again replaces itself. Deletions and names that were renamed away stay as touches: a change that comes
later but is older doesn't bring a row back. The table is the base and the last touches of all parts together, the same for any
split of the feed into micro-batches and any order in which they come. ``compact`` folds parts into one, so that a reader
opens few of them; a micro-batch costs what it holds, not what the table holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.incremental import last_touches, touches, with_touches
from lodestone.sources.shared import remove


def _parts(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(first batch, last batch, folder) of the whole parts, without those that a compacted one holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = []
    for s in fs.listStatus(at):
        m = re.fullmatch(r"batches-(\d+)-(\d+)", s.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append((int(m[1]), int(m[2]), s.getPath().toString()))
    return [p for p in found if not any(o[0] <= p[0] and p[1] <= o[1] and o != p for o in found)]


def writer(path: str, key: str, order: str, kind: str, old_key: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """The function for foreachBatch: keeps a micro-batch's last touches in its own folder. A batch that a compacted part
    holds already was written before, so it is left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if any(a <= batch_id <= b and a < b for a, b, _ in _parts(batch.sparkSession, path)):
            return
        found = last_touches(touches(batch, key, order, kind, old_key, columns))
        found.write.mode("overwrite").parquet(f"{path}/batches-{batch_id}-{batch_id}")

    return write


def known(spark: SparkSession, path: str) -> DataFrame | None:
    """The last touch of every key that the feed has named, None before the first micro-batch."""
    parts = _parts(spark, path)
    return last_touches(spark.read.parquet(*(p for _, _, p in parts))) if parts else None


def current(spark: SparkSession, path: str, base: DataFrame, key: str) -> DataFrame:
    """The base table after all micro-batches so far."""
    last = known(spark, path)
    return base if last is None else with_touches(base, last, key)


def compact(spark: SparkSession, path: str) -> None:
    """Fold all parts into one. The parts go once it is whole; a reader that still lists them has the same rows."""
    parts = _parts(spark, path)
    if len(parts) < 2:
        return
    low, high = min(p[0] for p in parts), max(p[1] for p in parts)
    known(spark, path).write.mode("overwrite").parquet(f"{path}/batches-{low}-{high}")
    for _, _, p in parts:
        remove(spark, p)
