import random
import re
from math import comb

import numpy as np
import pytest

from lodestone.llm import components as module
from lodestone.llm import neardup
from lodestone.llm.components import components
from lodestone.llm.shared import stored

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words, percent):
    sets = {}
    for doc, text in rows:
        own = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
        sets[doc] = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} or ({tuple(own)} if own else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def variants(seed, n_groups, copies, length, edits):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(length)] = word()
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "rows"), [(3, 85, variants(1, 12, 4, 40, 3)), (5, 80, variants(2, 6, 8, 60, 4))])
def test_components_match_brute_force(documents, words, percent, rows):
    rows = rows + [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (905, "a b c"), (906, "A b c")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(rows, extra=True), words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_large_bucket_of_near_copies_is_exact(documents, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = variants(3, 2, 60, 80, 9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_unlinked_texts_of_one_template_cost_rows_in_proportion(documents, monkeypatch):
    """Pages that share three quarters of their words and no more: one band bucket holds hundreds, but no pair of them is compared."""
    def never(*_):
        raise AssertionError("blocks of a large bucket")

    monkeypatch.setattr(neardup, "_of_large", never)
    made = []
    confirmed = neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *a: made.append(pairs.count()) or confirmed(pairs, *a))
    draw = random.Random(5)
    template = [f"t{k}" for k in range(90)]
    rows = [(k, " ".join([*template, *(f"w{draw.randrange(10**9)}" for _ in range(24))])) for k in range(400)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(0, 400, 40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)
    assert sum(made) < 10 * len(rows)


def test_kept_rows_null_ids_and_empty_table(documents):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (3, "x " * 30000)]
    got = neardup.near_duplicates(documents(rows)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)} and len(got) == 5
    assert neardup.near_duplicates(documents([])).count() == 0
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(documents(rows[:2] + rows[4:])).collect()) == [1, 3]


def test_rows_that_repeat_an_id_are_judged_by_their_text(documents):
    t, u = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(3, t), (5, t), (5, u), (7, u), (7, u), (5, "v w x y z v x")]
    got = neardup.near_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False)]
    kept = neardup.drop_near_duplicates(documents(rows, extra=True)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, t), (5, u), (5, "v w x y z v x")]


def test_versions_of_one_id_never_meet_in_a_node(documents):
    """(5, t) and (5, u) are unlike; each has near-copies of its own."""
    t, u = [" ".join(f"{x}{k}" for k in range(40)) for x in "tu"]
    rows = [(5, t), (5, u), (6, t + " more"), (8, u + " more"), (9, "more or less " + u)]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == {(5, 38): 5, (6, 39): 5, (8, 39): 5, (9, 41): 5}
    kept = neardup.drop_near_duplicates(documents(rows), 3, 85).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(5, t), (5, u)]


def test_hot_buckets_are_joined_apart(documents, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_LEAST", 2)
    monkeypatch.setattr(neardup, "HOT_SHARE", 0.0)
    rows = variants(8, 5, 9, 60, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(documents(rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_estimate_drops_a_pair_at_the_threshold_with_less_than_its_bound():
    for level in (0.8, 0.85):
        cut = neardup.most_apart(np.array([128.0, 4.0]), level)
        below = sum(comb(128, k) * level**k * (1 - level) ** (128 - k) for k in range(int(cut[0] * 128) + 1))
        assert 0.3 < cut[0] < level and below < neardup.LOSS and cut[1] == -1


def test_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []

    def counted(df, name):
        rounds.append(name)
        return stored(df, name)

    monkeypatch.setattr(module, "stored", counted)
    links = spark.range(1000).selectExpr("id a", "id + 1 b")
    got = components(links.coalesce(1)).collect()
    assert rounds.count("components-map") <= 12
    assert dict(got) == {k: 0 for k in range(1001)}


def test_components_of_chain_star_and_loops(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (140, 139), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 141)} | {200: 200, 201: 200}
