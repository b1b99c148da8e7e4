"""Streams give the rows of one ordered pass, whatever the micro-batches; change feeds give the table that plain Python gives."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import incremental as I
from lodestone.plans import analytics
from lodestone.plans.tables import table
from lodestone.streaming import changes, ordered, usage

BASE = dt.datetime(2024, 1, 1)


def played(spark, stream, path):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def disordered(spark, path, seed, n=240, keys=(1, 2, 3, None)):
    """Rows of up to half an hour's disorder in four files that are read one by one, and one that moves the watermark past them."""
    draw = random.Random(seed)
    rows = [(draw.choice(keys), draw.randint(0, 36_000)) for _ in range(n)]
    rows += rows[:5]
    order = sorted(rows, key=lambda r: r[1] + draw.randint(0, 1800))
    end = [(1, 100_000)]
    for k in range(4):
        some = order[k * len(order) // 4 : (k + 1) * len(order) // 4] + (end if k == 3 else [])
        spark.createDataFrame([(u, BASE + dt.timedelta(seconds=t)) for u, t in some], "u long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return rows, usage.read_stream(spark, f"{path}/in", maxFilesPerTrigger=1)


def plain(rows, seconds, limit=None):
    out = []
    for u in {u for u, _ in rows}:
        start, n = None, 0
        for t in sorted(t for v, t in rows if v == u):
            if start is None or t >= start + seconds:
                start, n = t, 0
            n += 1
            if limit is None:
                out += [(u, t)] if n == 1 else []
            else:
                out.append((u, t, start, n, n <= limit))
    return sorted(out, key=repr)


def seconds(t):
    return int((t - BASE).total_seconds())


def test_first_seen_in_disorder(spark, tmp_path):
    rows, stream = disordered(spark, f"file://{tmp_path}", 3)
    got = played(spark, usage.first_seen(stream, "ts", ["u"], "1 hour", "1 hour"), f"file://{tmp_path}").collect()
    want = plain(rows, 3600)
    assert sorted(((r["u"], seconds(r["ts"])) for r in got), key=repr) == want and len(want) > 20  # keys come back


def test_rate_limit_in_disorder(spark, tmp_path):
    rows, stream = disordered(spark, f"file://{tmp_path}", 4, keys=(1, 2, 3))
    got = played(spark, usage.rate_limited_stream(stream, "u", "ts", 4, 600, "1 hour"), f"file://{tmp_path}").collect()
    assert sorted(((r["u"], seconds(r["at"]), seconds(r["window_start"]), r["hit"], r["allowed"]) for r in got), key=repr) == plain(rows, 600, 4)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    path = f"file://{tmp_path}"
    for some in ([(1, 0), (1, 50_000)], [(1, 46_500)], [(1, 100), (1, 50_100)], [(1, 90_000)]):
        spark.createDataFrame([(u, BASE + dt.timedelta(seconds=t)) for u, t in some], "u long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
    got = played(spark, usage.first_seen(usage.read_stream(spark, f"{path}/in", maxFilesPerTrigger=1), "ts", ["u"], "10 seconds", "1 hour"), path).collect()
    assert sorted(seconds(r["ts"]) for r in got) == [0, 46_500, 50_000, 50_100]


class Kept:
    """A list state in memory that counts the questions it is asked."""

    def __init__(self):
        self.rows, self.asked = [], 0

    def exists(self):
        self.asked += 1
        return bool(self.rows)

    def get(self):
        self.asked += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.asked, self.rows = self.asked + 1, list(rows)

    def appendList(self, rows):
        self.asked += 1
        self.rows += rows

    def clear(self):
        self.asked, self.rows = self.asked + 1, []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(self.timers), self.timers.discard, self.timers.add

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())


class Values:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_keys_of_a_bucket_are_folded_in_one_visit(monkeypatch, chunk):
    """Rows of many keys, given out and kept in pieces; a visit asks the store as often for many keys as for one; all is forgotten in the end."""
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    fold = lambda state, t: ((t, 1), (t, t, 1)) if state is None or t >= state[0] + 50_000 else ((state[0], state[1] + 1), (t, state[0], state[1] + 1))
    asked = {}
    for n_keys in (1, 40):
        draw, handle = random.Random(6), Handle()
        bucket = ordered._Ordered(["t", "s", "hit"], fold, lambda state: state[0] + 50_000)
        bucket.init(handle)
        rows = [(f"k{draw.randrange(n_keys)}", draw.randrange(900_000)) for _ in range(400)]
        got = []
        for k, watermark in enumerate((0, 200, 400, 650)):
            some = [r for r in rows if k == min(3, r[1] // 220_000)]
            out = list(bucket.handleInputRows((7,), iter([pd.DataFrame(some[::2], columns=["key", "t"]), pd.DataFrame(some[1::2], columns=["key", "t"])]), Values(watermark)))
            got += out
            assert all(len(b) <= chunk for b in out) and all(len(e[0]) <= chunk for s in handle.states.values() for e in s.rows) and len(handle.timers) == 1 and min(handle.timers) > watermark
        asked[n_keys] = sum(s.asked for s in handle.states.values())
        got += [b for watermark in (900, 1000) for b in bucket.handleExpiredTimer((7,), Values(watermark), None)]
        assert sorted(tuple(r) for b in got for r in b.to_numpy().tolist()) == [r[:4] for r in sorted(plain(rows, 50_000, 2))] and not any(s.rows for s in handle.states.values())
    assert asked[1] == asked[40] <= 4 * 8


def test_timers_do_not_grow_with_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 3)
    path = f"file://{tmp_path}"
    rows = spark.range(200).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    rows.coalesce(1).write.parquet(f"{path}/in")
    stream = usage.rate_limited_stream(usage.read_stream(spark, f"{path}/in"), "id", "ts", 2, 60, "10 seconds")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"]]
    assert 0 < max(timers) <= 3 and spark.read.parquet(f"{path}/out").count() == 190


def test_keys_of_odd_kinds_keep_their_values(spark, tmp_path):
    """Nulls, quotes, microseconds, and numbers that no double holds; zeros of both signs are one key."""
    path = f"file://{tmp_path}"
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    kinds = [(None, None, None, None), ('a"\\\n', 2**60 + 1, at, 0.0), ('a"\\\n', 2**60 + 1, at, -0.0), ("", 2**60 + 3, at + dt.timedelta(microseconds=1), float("inf")), ("ä€", -1, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), 0.1)]
    rows = [(*k, BASE + dt.timedelta(seconds=n)) for n, k in enumerate(kinds)] + [("end", 0, at, 1.0, BASE + dt.timedelta(days=9))]
    spark.createDataFrame(rows, "s string, n long, w timestamp, d double, ts timestamp").coalesce(1).write.parquet(f"{path}/in")
    got = played(spark, usage.first_seen(usage.read_stream(spark, f"{path}/in"), "ts", ["s", "n", "w", "d"], "1 hour", "1 hour"), path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[-1]) == [r for n, r in enumerate(rows[:5]) if n != 2]


def test_parts_of_a_stream_are_many_files_each(spark, monkeypatch):
    """A part's files come in one micro-batch, even if a part has fewer rows than files; the rows are those of the batch form."""
    monkeypatch.setattr(analytics, "PART_ROWS", 40)
    sf_dir, seen = "/root/testdata/sf0.001", []
    read = usage.read_stream
    monkeypatch.setattr(analytics.U, "read_stream", lambda s, path, **o: seen.append((path, o)) or read(s, path, **o))
    got = analytics.stream_dedup_ttl(spark, sf_dir)
    ((path, options),) = seen
    events = table(spark, sf_dir, "events")
    n = events.count() // 40 + 1
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").collect()
    assert n > 20 and options == {"maxFilesPerTrigger": n} and len(files) == 6 * n
    by_time = [f["path"] for f in sorted(files, key=lambda f: f["modificationTime"])]
    shifted = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86400))
    spans = [spark.read.parquet(*by_time[k * n : (k + 1) * n]).agg(F.min(shifted), F.max(shifted)).first() for k in range(6)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    passed = F.lit(events.agg(F.max("ts")).first()[0] - dt.timedelta(days=3))
    want = usage.first_seen(events, "ts", ["user_id"], "6 hours").where(F.col("ts") <= passed)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 100


def random_feed(seed, n=200):
    draw, feed = random.Random(seed), []
    for k in range(n):
        kind = draw.choice("AAMDRRCT")
        feed.append((f"k{draw.randint(0, 11)}", k, kind, f"k{draw.randint(0, 11)}" if kind == "R" else None, f"v{k}"))
    return feed


def followed(table, feed):
    for key, _, kind, old, v in sorted(feed, key=lambda r: r[1]):
        if kind == "R":
            table.pop(old, None)
        if kind == "D":
            table.pop(key, None)
        else:
            table[key] = v
    return table


SCHEMA = "k string, n int, kind string, old string, v string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_in_order(spark, seed):
    base = {f"k{k}": "old" for k in range(0, 20, 2)}
    table = spark.createDataFrame(list(base.items()), "k string, v string")
    feed = random_feed(seed)
    got = dict(map(tuple, I.apply_changes(table, spark.createDataFrame(feed, SCHEMA), "k", "n", "kind", "old").collect()))
    assert got == followed(dict(base), feed)


def test_rename_chains_and_names_taken_again(spark):
    table = spark.createDataFrame([("z", "0")], "k string, v string")
    for feed, want in (
        ([("a", 1, "A", None, "1"), ("b", 2, "R", "a", "2")], {"z": "0", "b": "2"}),
        ([("a", 1, "A", None, "1"), ("b", 2, "R", "a", "2"), ("c", 3, "R", "b", "3"), ("a", 4, "A", None, "4")], {"z": "0", "c": "3", "a": "4"}),
        ([("z", 1, "D", None, None), ("z", 2, "A", None, "2"), ("y", 3, "R", "z", "3"), ("z", 4, "R", "y", "4")], {"z": "4"}),
        ([("z", 1, "R", "z", "1")], {"z": "1"}),
        ([], {"z": "0"}),
    ):
        got = dict(map(tuple, I.apply_changes(table, spark.createDataFrame(feed, SCHEMA), "k", "n", "kind", "old").collect()))
        assert got == want


def test_change_stream_is_the_batch_form(spark, tmp_path):
    """Parts in any order, played twice, folded in between: the same table each time."""
    base = {f"k{k}": "old" for k in range(0, 20, 2)}
    table = spark.createDataFrame(list(base.items()), "k string, v string")
    feed = random_feed(7)
    want = followed(dict(base), feed)
    path = f"file://{tmp_path}/parts"
    write = changes.writer(path, "k", "n", "kind", "old", ["k", "v"])
    assert dict(map(tuple, changes.current(spark, path, table, "k").collect())) == base
    draw = random.Random(1)
    draw.shuffle(feed)
    parts = [feed[k::4] for k in range(4)]
    for k, part in enumerate(parts):
        write(spark.createDataFrame(part, SCHEMA), k)
        if k == 1:
            changes.compact(spark, path)
            write(spark.createDataFrame(parts[0], SCHEMA), 0)
    write(spark.createDataFrame(parts[3], SCHEMA), 3)
    assert dict(map(tuple, changes.current(spark, path, table, "k").collect())) == want
    changes.compact(spark, path)
    assert len(changes._parts(spark, path)) == 1
    assert dict(map(tuple, changes.current(spark, path, table, "k").collect())) == want


def test_full_walk_tells_failure_from_quiet(spark):
    feed = lambda *rows: spark.createDataFrame(list(rows), "path string, old_path string")
    full = lambda df, **k: I.needs_full_walk(df, **k).first()["full"]
    assert not full(feed()) and full(feed(), failed=True) and not full(feed(("a.go", None), (None, None)))
    assert full(feed(("go.mod", None))) and full(feed(("b", "go.mod"))) and not full(feed(("sub/go.mod", None)))
    assert not feed().where(F.lit(True)).count()
