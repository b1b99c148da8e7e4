"""The audit against plain Python over all terms, with small bounds so that chunks and blocks are many."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UPPER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=lambda t: t.encode())
        p = {}
        for s in [*sources, None]:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 1_000_000_000 * (counts[lang, s][t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((p[None][t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, i, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def random_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["Ab", "ab", "é", "É", "zz", "日本", "a", "b1c", "x_y", "\U0001f600q", "end\x00", "ſ"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 7)}") for _ in range(n)]
    rows += [(None, "en", "s0"), ("", "xx", "only"), ("", "xx", "other"), ("ab ab", None, None), ("ab", "en", None), ("hello " * 50, "en", "hot")]
    return rows + [rows[3]] * 3


@pytest.mark.parametrize("size,block", [(4096, 256), (3, 2)])
def test_all_rows_by_brute_force(spark, size, block):
    rows = random_rows(5)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "1 as term", "2 as counts", "3 as block", "4 as n", "'x' as chunk", "5 as rank").repartition(5)
    got = divergence.audit(df, min_docs=4, top=5, size=size, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 5)


def test_empty_table_and_language_without_kept_terms(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(1, "a", "en", "x"), (2, "b", "en", "y"), (None, "c", "fr", "z")], schema)
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_for_large_counts():
    count, n, v = np.array([10**15, 3, 0]), 4 * 10**15, 1000
    assert divergence.shares(count, n, v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v) for c in count.tolist()]


def test_task_tables_are_flushed_and_combined(monkeypatch):
    monkeypatch.setattr(divergence, "COMBINE_ROWS", 3)
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 2)
    rows = random_rows(9, 40)
    batches = [pa.record_batch([[r[k] or "" for r in rows[i : i + 7]] for k in range(3)], names=["text", "lang", "source"]) for i in range(0, len(rows), 7)]
    got, want = Counter(), Counter()
    for b in divergence.counted(iter(batches)):
        for lang, source, term, _, n in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, source, term] += n
    for text, lang, source in rows:
        want.update((lang or "", source or "", t) for t in TERM.findall((text or "").translate(UPPER)))
    assert {k: n for k, n in got.items() if n} == dict(want)
