import pickle
import random
import time

import numpy as np

from lodestone.llm import decontam

ITEMS = "item_id long, text string"


def brute_tiles(text, item, least):
    """Greedy tiling by trying every pair of positions."""
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = []
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while t + n < len(text) and i + n < len(item) and free_t[t + n] and free_i[i + n] and text[t + n] == item[i + n]:
                    n += 1
                best.append((n, t, i))
        top = max((n for n, _, _ in best), default=0)
        if top < least:
            return out
        for n, t, i in best:
            if n == top and all(free_t[t : t + n]) and all(free_i[i : i + n]):
                free_t[t : t + n] = free_i[i : i + n] = [False] * n
                out.append((t, i, n))


def test_tiles_match_brute_force():
    draw = np.random.default_rng(5)
    for _ in range(150):
        text, item = (draw.integers(0, 3, draw.integers(0, 22)).astype(np.uint64) for _ in range(2))
        assert decontam.tiles(text, item, 3) == brute_tiles(text.tolist(), item.tolist(), 3)


def cases():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)]
    noise = lambda n: " ".join(word() for _ in range(n))
    whole = items[3][1]
    words = items[4][1].split()
    swapped = " ".join(words[20:] + [word()] + words[:10] + [word()] + words[10:20])
    part = " ".join(items[5][1].split()[:9])
    rows = [
        (0, noise(50), None), (1, f"{noise(20)} {whole.upper()} {noise(20)}", 3), (2, f"{noise(9)} {swapped}", 4), (3, f"{noise(40)} {part} {noise(4)}", None),
        (4, None, None), (5, "", None), (6, noise(20000) + " " + items[7][1], 7), (7, whole + " " + items[8][1], 3), (8, "tiny item", None), (8, "tiny item", None),
    ]
    return items, rows


def test_reordered_passages_are_caught_and_clean_ones_stay(spark, documents):
    items, rows = cases()
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (None, "x y z a b c")], ITEMS)
    docs = documents([(d, t) for d, t, _ in rows], extra=True).selectExpr("*", "1 as item_id", "2 as n_items", "3 as coverage", "'x' as item")
    for limit in (decontam.BROADCAST_WORDS, 10):  # both forms give the same
        got = sorted(decontam.judge(docs, bench, limit).collect(), key=lambda r: r["doc_id"])
        assert [r["contaminated"] for r in got] == [i is not None for _, _, i in rows]
        assert [r["item_id"] for r in got if r["contaminated"]] == [i for _, _, i in rows if i is not None]
        assert got[2]["n_tiles"] == 3 and got[2]["coverage"] == 1.0 and got[7]["n_items"] == 2 and 0 < got[3]["coverage"] < 0.5
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 8, 8]


def test_repeated_items_count_once_in_both_forms(spark, documents):
    text = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text + " nine"), (None, text), (None, text), (3, "a b c d e f")], ITEMS)
    docs = documents([(1, text), (1, text), (2, "x " + text + " nine"), (3, "a b c d e f")])
    both = [sorted(tuple(r) for r in decontam.judge(docs, bench, limit).collect()) for limit in (decontam.BROADCAST_WORDS, 0)]
    assert both[0] == both[1] == [(1, True, 1, 1.0, 1, 4), (1, True, 1, 1.0, 1, 4), (2, True, 1, 1.0, 1, 4), (3, True, 3, 1.0, 1, 1)]
    nameless = spark.createDataFrame([(None, text)], ITEMS)
    for limit in (decontam.BROADCAST_WORDS, 0):
        assert [(r["contaminated"], r["item_id"], r["n_items"]) for r in decontam.judge(docs.where("doc_id = 2"), nameless, limit).collect()] == [(True, None, 1)]


def test_bytes_bound_the_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(decontam, "_Index", None)  # the index must not be built
    assert decontam.judge(documents(["q" * 100]), spark.createDataFrame([(1, "q" * 100)], ITEMS)).first()["contaminated"]


def test_repetitive_texts_take_linear_work():
    began = time.perf_counter()
    got = decontam.tiles(np.full(8000, 7, np.uint64), np.full(800, 7, np.uint64))
    turns = decontam.tiles(np.arange(8000, dtype=np.uint64) % 3, np.arange(800, dtype=np.uint64)[::-1] % 3)
    assert got == [(0, 0, 800)] and turns == [] and time.perf_counter() - began < 5


def test_index_is_small():
    draw = np.random.default_rng(1)
    items = [(k, " ".join(map(str, draw.integers(0, 10**6, 200)))) for k in range(500)]
    assert len(pickle.dumps(decontam._Index(items), 5)) < 40 * 100_000


def test_short_items_and_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "Short item"), (2, "Short item"), (3, "one")], ITEMS)
    docs = documents([(1, "a short ITEM b"), (2, "short b item"), (2, "ONE"), (3, None)])
    for limit in (decontam.BROADCAST_WORDS, 1):
        got = sorted((r["doc_id"], r["contaminated"], r["item_id"], r["n_items"]) for r in decontam.judge(docs, bench, limit).collect() if r["item_id"])
        assert got == [(1, True, 1, 2), (2, True, 3, 1)]
        assert decontam.judge(docs, bench, limit).count() == 4
    assert not decontam.judge(documents([(1, "a b c d e f")]), spark.createDataFrame([], ITEMS)).first()["contaminated"]
    assert decontam.judge(documents([]), bench).count() == 0


def test_verdicts_are_those_of_all_pairs(spark, documents):
    """Every text with every item, tiled by trying all positions, in both forms."""
    draw = random.Random(12)
    vocabulary = [f"w{k}" for k in range(9)]
    items = [(k % 7 if k % 5 else None, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 2, 4, 6, 9, 14])))) for k in range(14)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 26))) for _ in range(25)] + [None, items[3][1] or "w1", f"{items[4][1]} {items[6][1]}"]
    want = []
    for d, text in enumerate(texts):
        words, found = (text or "").split(), []
        for item, passage in set(items):
            own = passage.split()
            least = min(decontam.SEED, len(own))
            seeds = {tuple(own[i : i + least]) for i in range(len(own) - least + 1)} if own else set()
            if any(tuple(words[t : t + least]) in seeds for t in range(len(words) - least + 1)):
                tiles = brute_tiles(words, own, least)
                found.append((sum(n for _, _, n in tiles) / len(own), item is not None, -(item or 0), len(tiles), item))
        best = max(found, key=lambda x: x[:4]) if found else (0.0, None, None, 0, None)
        n = sum(x[0] >= decontam.COVERAGE for x in found)
        want.append((d, n > 0, best[4], round(best[0], 9), best[3], n))
    bench = spark.createDataFrame(items, ITEMS)
    for limit in (decontam.BROADCAST_WORDS, 0):
        got = sorted((r["doc_id"], r["contaminated"], r["item_id"], round(r["coverage"], 9), r["n_tiles"], r["n_items"]) for r in decontam.judge(documents(texts), bench, limit).collect())
        assert got == want, limit
    assert any(w[1] for w in want) and not all(w[1] for w in want)
