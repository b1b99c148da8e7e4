"""Usage logs as streams, each with the batch form that gives the same rows.

All of them read any streaming DataFrame with an event time; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.streaming.ordered import in_order


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A growing Parquet table, or one file, as a stream. Its files are listed once to read their schema."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema).options(**options)
    if any(f.endswith(f"/{name}") for f in table.inputFiles()[:1]):  # streams read folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def windowed(events: DataFrame, at: str, width: str, keys: list[str], aggregates: list[Column], late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(bucket, keys, aggregates) of tumbling or sliding windows; later rows than ``late`` are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("bucket"), *keys, *(c for c in out.columns if c not in ("w", *keys)))


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def first_seen(events: DataFrame, at: str, keys: list[str], ttl: str = "24 hours", late: str = "1 day") -> DataFrame:
    """Rows whose key wasn't taken at their time: a row that is taken holds its key for the time to live, and
    the next row after that is taken again.

    Batches are hashed by key, sorted by time and passed once, so a key of many rows needs no more memory than another. A stream
    gives the same rows, each once the watermark (``late`` behind the newest row) has passed it, in whatever order they come.
    Rows of a null key are one key, those without a time are left out; columns beside keys and time are dropped in both forms.
    """
    rows = events.select(*keys, at)
    seconds = events.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP'2000-01-01' + INTERVAL {ttl}) - unix_micros(TIMESTAMP'2000-01-01')").first()[0]
    if events.isStreaming:
        take = lambda state, t: ((t + seconds, 0), (t,)) if state is None or t >= state[0] else (state, None)
        return in_order(rows, keys, at, late, "t long", take, lambda state: state[0]).select(*keys, F.timestamp_micros("t").alias(at))

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, 0
        for b in batches:
            keep = []
            for k, t in zip(b["_key"].tolist(), b["_t"].tolist(), strict=True):
                keep.append(k != current or t >= free)
                if keep[-1]:
                    current, free = k, t + seconds
            yield b[keep]

    marked = rows.where(F.col(at).isNotNull()).withColumns({"_key": F.to_json(F.struct(*keys)), "_t": F.unix_micros(at)})
    return marked.repartition("_key").sortWithinPartitions("_key", "_t").mapInPandas(taken, marked.schema).drop("_key", "_t")


def retained(logs: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    return logs.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def rate_limited(events: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """Batch replay of a fixed window that starts at a key's first hit: (key, at, window_start, hit, allowed).

    Keys are hashed to partitions and sorted there, and one pass goes over each, so a key of many hits
    needs no more memory than another.
    """
    kind = events.schema[key].dataType.simpleString()

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, n = None, 0, 0
        for b in batches:
            out = []
            for k, t in zip(b["key"].tolist(), b["t"].tolist(), strict=True):
                if current is None or k != current[0] or t >= start + seconds * 1_000_000:
                    current, start, n = (k,), t, 0
                n += 1
                out.append((k, t, start, n, n <= limit))
            yield pd.DataFrame(out, columns=["key", "t", "s", "hit", "allowed"])

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(at).alias("t"))
    found = rows.repartition("key").sortWithinPartitions("key", "t").mapInPandas(replay, f"key {kind}, t long, s long, hit long, allowed boolean")
    return found.select(F.col("key").alias(key), F.timestamp_micros("t").alias("at"), F.timestamp_micros("s").alias("window_start"), "hit", "allowed")


def rate_limited_stream(events: DataFrame, key: str, at: str, limit: int, seconds: int, late: str = "1 minute") -> DataFrame:
    """The same on a stream: a hit is counted once the watermark, ``late`` behind the newest hit, has passed it."""
    width = seconds * 1_000_000

    def count(state: tuple[int, int] | None, t: int) -> tuple[tuple[int, int], tuple]:
        start, n = (t, 1) if state is None or t >= state[0] + width else (state[0], state[1] + 1)
        return (start, n), (t, start, n, n <= limit)

    found = in_order(events.where(F.col(key).isNotNull()), [key], at, late, "t long, s long, hit long, allowed boolean", count, lambda state: state[0] + width)
    return found.select(key, F.timestamp_micros("t").alias("at"), F.timestamp_micros("s").alias("window_start"), "hit", "allowed")


def stale_runs(runs: DataFrame, live: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Queued or running rows that are older than the limit and that the queue doesn't confirm."""
    old = runs.where(F.col("status").isin("queued", "running") & (F.coalesce("started_at", "created_at") < now - F.make_interval(mins=F.lit(minutes))))
    return old.join(live.select("id"), "id", "left_anti")


def next_sync(schedule: Column, now: Column, hour: int) -> Column:
    """When a source is due again: hourly, daily, or Mondays at an hour; null for manual and webhook."""
    today = F.date_trunc("day", now) + F.make_interval(hours=F.lit(hour))
    day = F.make_interval(days=F.lit(1))
    weekday = F.weekday(now)
    monday = F.date_add(now.cast("date"), F.pmod(-weekday, F.lit(7)).cast("int")).cast("timestamp") + F.make_interval(hours=F.lit(hour))
    return (
        F.when(schedule == "hourly", F.date_trunc("hour", now) + F.make_interval(hours=F.lit(1)))
        .when(schedule == "daily", F.when(today <= now, today + day).otherwise(today))
        .when(schedule == "weekly", F.when(monday <= now, monday + F.make_interval(weeks=F.lit(1))).otherwise(monday))
    )


def due(sources: DataFrame, now: Column) -> DataFrame:
    return sources.where(F.col("next_sync_at") <= now).orderBy("next_sync_at", "id")


def append(batch: DataFrame, path: str) -> None:
    """foreachBatch sink: add a micro-batch to a log table."""
    batch.write.mode("append").parquet(path)
