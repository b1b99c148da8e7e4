import random
import re
from collections import defaultdict

from lodestone.llm import mixing


def expected_targets(sizes, most=3):
    """Targets by sharing the excess again until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        share = sum(weight[s] for s in open_)
        target |= {s: left * weight[s] / share for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            full.add(s)


def make(seed, n, sources):
    draw = random.Random(seed)
    return [(k, " ".join("w" for _ in range(draw.randint(0, 60))), draw.choice(sources)) for k in range(n)]


def check(rows, got, slack):
    sizes, taken = defaultdict(int), defaultdict(int)
    of = {d: (len(re.findall("[^\x20\x09-\x0d]+", t or "")), s) for d, t, s in rows}
    for n, s in of.values():
        sizes[s] += n
    target = expected_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        n, s = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * n
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack * max(20, target[s]), s


def test_targets_and_taken(documents):
    rows = make(1, 800, ["a", "B", "é", "z", None, "z", "z", "z"]) + [(9000, "only", "tiny"), (9001, None, "blank"), (9002, "", "a"), (9003, "long " * 5000, "b2")]
    got = mixing.mix(documents(rows, extra=True)).collect()
    check(rows, got, 0.02)
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_one_source_repeated_rows_and_empty(documents):
    assert mixing.mix(documents([])).count() == 0
    assert sorted(tuple(r) for r in mixing.mix(documents([(1, None, None), (2, "", None)])).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    got = mixing.mix(documents([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s")])).collect()
    assert [(r["doc_id"], r["taken"]) for r in sorted(got, key=lambda r: r["taken"])] == [(None, 1), (1, 3), (1, 3)]


def test_two_level_sums_do_not_depend_on_parts(documents, monkeypatch):
    rows = make(2, 400, ["a", "b"])
    monkeypatch.setattr(mixing, "PART", 16)
    check(rows, mixing.mix(documents(rows)).collect(), 0.02)


def test_no_python_in_the_plan(documents, capsys):
    mixing.mix(documents(make(3, 50, ["a", "b"]))).explain("extended")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_mixture_keeps_rows_and_columns(documents):
    docs = documents(make(4, 200, ["a", "b", "c"]))
    out = mixing.mixture(docs)
    assert out.columns == [*docs.columns, "size", "taken"]
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    assert {r["doc_id"]: r["taken"] for r in out.collect()} == plan
    assert mixing.mixture(documents(make(4, 200, ["a", "b", "c"]), extra=True)).columns.count("size") == 1


def test_small_sources_beside_a_huge_one_reach_their_targets(documents):
    rows = [(k, "w " * 100_000, "huge") for k in range(60)]
    rows += [(1000 + k, "w " * n, s) for k, (n, s) in enumerate([(100, "a"), (200, "a"), (1500, "b"), (1500, "b"), (1, "c"), (7, "zz")])]
    got = mixing.mix(documents(rows)).collect()
    check(rows, got, 0.02)
    assert all(r["taken"] for r in got if r["doc_id"] >= 1000)
