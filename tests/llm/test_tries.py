"""The trie against plain Python over all rebuilt conversations."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full = tuple(own.get(base, [])[:h]) + tuple(xs[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, cs in members.items():
        worth = (len(cs) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += worth
            leaves[path[:d]] += not children[path]
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, cs in members.items()
    )


def got(df):
    out = tries.prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_nodes_by_brute_force(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    texts = ["a b", "a b", "c", "", None, "d e f", " x", "x\ty\n"]
    rows = []
    for c in list(range(-25, 70)) + [1003, 1019]:
        n = int(rng.integers(0, 6))
        rows += [(c, None if rng.random() < 0.1 else int(rng.integers(0, 4)), str(rng.choice(["user", "bot"])) if rng.random() < 0.9 else None, texts[rng.integers(0, len(texts))]) for _ in range(n)]
    for c in (200, 201, 202, 203, 223):  # copies, longer than a stored piece
        rows += [(c, k, "user", f"turn {k % 7}") for k in range(40)]
    rows += [(203, 41, "user", "more"), (None, 0, "user", "lost"), rows[0], rows[0], (300, 0, "u", "long " * 5000)]
    monkeypatch.setattr(tries, "COMBINE", 50)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as base", "3 as digest", "'x' as parent").repartition(5)
    assert got(df) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_pieces_hold_whole_paths():
    import pyarrow as pa

    old, tries.PIECE = tries.PIECE, 4
    try:
        n = 11
        batch = pa.record_batch([pa.array([20] * n), pa.array([20] * n), pa.array([1] * n), pa.array([bytes([k]) * 16 for k in range(n)], pa.binary()), pa.array(range(n))], names=["conv_id", "base", "borrowed", "digest", "n_words"])
        pieces = list(tries.rebuilt(iter([batch])))
        assert [p["start"].to_pylist() for p in map(lambda b: {c: b.column(c) for c in b.schema.names}, pieces)] == [[0, 4, 8]]
        nodes = list(tries.partial_trie(iter(pieces)))[0]
        by_depth = sorted(zip(*(nodes.column(c).to_pylist() for c in ("depth", "key", "parent", "before", "ends"))))
        assert [d[0] for d in by_depth] == list(range(n + 1))
        assert by_depth[0][2] is None and all(b[2] == a[1] for a, b in zip(by_depth, by_depth[1:]))
        assert [d[3] for d in by_depth] == [0] + [sum(range(k)) for k in range(n)]
        assert [d[4] for d in by_depth] == [[]] * n + [[20]]
    finally:
        tries.PIECE = old


def test_runs_of_ends_join_to_one_hash(spark, monkeypatch):
    rows = [(c, 0, "u", "same") for c in range(0, 400)]
    out = [r for r in got(spark.createDataFrame(rows, SCHEMA).repartition(7))]
    assert out == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_empty_table_and_turnless_conversations(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "gone")]  # its only turn is replaced by none
    assert got(spark.createDataFrame(rows, SCHEMA)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
