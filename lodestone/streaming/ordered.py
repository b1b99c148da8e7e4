"""Keyed streams that must see the rows of a key in the order of their time.

Rows wait in a state until the watermark has passed them; then they are folded in order. A timer wakes the state for
those that still wait. So the result is that of one ordered pass over all rows, for any split into micro-batches and
any disorder within the allowed lateness; rows later than the watermark are dropped before they come here.

Keys are dealt by hash over BUCKETS buckets and a bucket is one state of RocksDB: a visit, its timer and each question to the store
serve all keys of a bucket, so their number doesn't grow with the keys. A bucket holds the rows that wait and what its keys' folds
have come to, as lists of up to CHUNK entries; a key whose state no longer matters is forgotten when its bucket is visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 512  # a checkpoint belongs to its number of buckets
CHUNK = 100_000  # rows that are given out, or kept as one entry of a state, at once

#: Keys are texts inside a bucket; times in them are exact.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: Takes the state (None at first) and a time in microseconds; gives the new state, a pair of numbers, and the row to give out or None.
Fold = Callable[[tuple[int, int] | None, int], tuple[tuple[int, int], tuple | None]]


class _Ordered(StatefulProcessor):
    def __init__(self, columns: list[str], fold: Fold, until: Callable[[tuple[int, int]], int]) -> None:
        self.columns, self.fold, self.until = columns, fold, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key array<string>, t array<long>")
        self.states = handle.getListState("states", "key array<string>, a array<long>, b array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self._pass([(b["key"], b["t"]) for b in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._pass([], timerValues.getCurrentWatermarkInMs())

    def _pass(self, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        passed = watermark * 1000
        n_new = sum(len(t) for _, t in new)
        keys, times = _joined([*new, *_entries(self.waiting)])
        ready = times <= passed
        left = ~ready
        if ready[n_new:].any():
            _replace(self.waiting, keys[left], times[left])
        elif left[:n_new].any():
            self.waiting.appendList(_chunks(keys[:n_new][left[:n_new]], times[:n_new][left[:n_new]]))
        held = {k: s for key, a, b in _entries(self.states) for k, s in zip(key, zip(a, b, strict=True), strict=True)}
        states = dict(held)
        code, names = pd.factorize(keys[ready])
        order = np.lexsort((times[ready], code))
        code, ordered = code[order], times[ready][order]
        key = None
        for low in range(0, len(order), CHUNK):
            out = []
            for c, t in zip(code[low : low + CHUNK].tolist(), ordered[low : low + CHUNK].tolist(), strict=True):
                key = names[c]
                states[key], row = self.fold(states.get(key), t)
                if row is not None:
                    out.append((key, *row))
            if out:
                yield pd.DataFrame(dict(zip(["key", *self.columns], zip(*out, strict=True), strict=True)))
        states = {k: s for k, s in states.items() if self.until(s) > passed}
        if states != held:
            _replace(self.states, list(states), *np.array(list(states.values()), np.int64).reshape(-1, 2).T)
        if left.any():
            self._wake(int(times[left].min()), watermark)
        elif states:
            self._wake(max(map(self.until, states.values())), watermark)

    def _wake(self, t: int, watermark: int) -> None:
        """Once the watermark has passed a time."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(-(-t // 1000), watermark + 1))

    def close(self) -> None:
        pass


def _entries(state: Any) -> list[tuple]:
    return list(state.get()) if state.exists() else []


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, times) of parts of them."""
    if not parts:
        return np.zeros(0, object), np.zeros(0, np.int64)
    return np.concatenate([np.asarray(k, object) for k, _ in parts]), np.concatenate([np.asarray(t, np.int64) for _, t in parts])


def _chunks(*columns: Any) -> list[tuple]:
    lists = [np.asarray(c).tolist() for c in columns]
    return [tuple(c[low : low + CHUNK] for c in lists) for low in range(0, len(lists[0]), CHUNK)]


def _replace(state: Any, *columns: Any) -> None:
    if entries := _chunks(*columns):
        state.put(entries)
    else:
        state.clear()


def _same(column: Column, kind: Any) -> Column:
    """Zeros of both signs are one key, as in every grouping."""
    return (column + F.lit(0.0)).cast(kind) if isinstance(kind, (FloatType, DoubleType)) else column


def in_order(events: DataFrame, keys: list[str], at: str, late: str, columns: str, fold: Fold, until: Callable[[tuple[int, int]], int]) -> DataFrame:
    """(keys, columns) that ``fold`` gives for the times of each key of a stream in order. until: the time, in microseconds, from which a
    state is as good as none. The session's state store provider is set to RocksDB for queries started from here on."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = StructType([StructField(f"key{k}", events.schema[c].dataType) for k, c in enumerate(keys)])
    named = F.to_json(F.struct(*(_same(F.col(c), f.dataType).alias(f.name) for c, f in zip(keys, kind, strict=True))), _JSON)
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, late).select(named.alias("key"), F.unix_micros(at).alias("t"), F.col(at).alias("at"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    names = StructType.fromDDL(columns).names
    found = dealt.groupBy("bucket").transformWithStateInPandas(_Ordered(names, fold, until), f"key string, {columns}", "Append", "EventTime")
    back = found.withColumn("key", F.from_json("key", kind, _JSON))
    return back.select(*(F.col(f"key.{f.name}").alias(c) for c, f in zip(keys, kind, strict=True)), *names)
