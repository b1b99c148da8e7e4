"""Neighbours against all pairs: recall, exact scores and ties, and whole results where a query probes every part."""

import numpy as np
import pytest

from lodestone.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def plain(vectors, k, every):
    out = {}
    for q, a in vectors.items():
        if q % every == 0:
            near = sorted(((-cosine(a, b), c) for c, b in vectors.items() if c != q))[:k]
            out[q] = [(c, -s) for s, c in near]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def clustered(seed, n, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    return {k: (centres[rng.integers(0, 12)] + spread * rng.standard_normal(16)).astype(np.float32).astype(float) for k in range(n)}


def test_recall_and_scores(spark):
    vectors = clustered(3, 3000)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in vectors.items()], SCHEMA)
    got = found(neighbours.nearest_neighbours(df).collect())
    want = plain(vectors, 5, 50)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert np.mean([len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 5 for q in want]) >= 0.9
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(abs(s - cosine(vectors[q], vectors[c])) < 1e-12 and c != q for c, s in near)


def test_router_probes_few_parts_of_clusters():
    x = np.array(list(clustered(4, 4000, 0.2).values()))
    router = neighbours.fit(x)
    assert router.parts == 32
    _, before = router.probed(neighbours.unit(x[:400]))
    assert (before < router.mass).sum(axis=1).mean() < 12


def test_parts_are_balanced_and_cut_few_edges():
    x = neighbours.unit(np.array(list(clustered(5, 1024, 0.2).values())))
    graph = neighbours.nearest(x, x, 10, np.arange(len(x)))
    part = neighbours.balanced_parts(graph, 8)
    assert np.ptp(np.bincount(part)) <= 1
    assert (part[graph] == part[:, None]).mean() > 0.8


def test_few_rows_copies_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(6)
    vectors = {k: rng.integers(-3, 4, 4).astype(float) + [0, 0, 0, 0.5] for k in range(120)}
    for k in range(100, 120):
        vectors[k] = vectors[0]  # more copies than are kept; 100 and 0 are queries
    vectors[50] = vectors[7] * 2
    rows = [(k, v.tolist(), 1) for k, v in vectors.items()]
    rows += [(150, None, 1), (200, [0.0] * 4, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [float("nan")] * 4, 1), (350, [float("inf"), 0.0, 0.0, 0.0], 1), (400, [], 1), (450, [1.0, 2.0], 1), (None, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as hash", "3 as query", "4 as vector", "5 as a").repartition(3)
    got, want = found(neighbours.nearest_neighbours(df).collect()), plain(vectors, 5, 50)
    assert got.keys() == want.keys() == {0, 50, 100}
    for q in want:
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
    assert [c for c, _ in got[0]] == [100, 101, 102, 103, 104] and [c for c, _ in got[100]] == [0, 101, 102, 103, 104]
    assert got[50][0] == (7, pytest.approx(1.0))


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_all_candidates_where_there_are_fewer(spark, n):
    df = spark.createDataFrame([(50 * k, [1.0 + k, 1.0], 0) for k in range(n)], SCHEMA)
    got = found(neighbours.nearest_neighbours(df).collect())
    assert {q: {c for c, _ in x} for q, x in got.items()} == {50 * k: {50 * o for o in range(n) if o != k} for k in range(n) if n > 1}


def test_blocks_give_the_same_rows_and_repeats_are_candidates(spark):
    vectors = clustered(8, 700)
    rows = [(k, v.tolist(), 0) for k, v in vectors.items()] + [(50, vectors[50].tolist(), 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    usable = neighbours.usable(df)
    router = neighbours.router_of(usable)
    index, asked = neighbours.indexed(usable, router), usable.where("vec_id % 50 = 0").selectExpr("vec_id as query", "vector").distinct()
    whole, cut = (sorted(map(tuple, neighbours.search(index, asked, router, 6, b).select("query", "vec_id", "score").collect())) for b in (10**6, 40))
    assert whole == cut
    assert found(neighbours.nearest_neighbours(df).collect())[50][0] == (50, pytest.approx(1.0))


def test_huge_and_tiny_components():
    a = np.array([[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0]])
    b = np.array([[1e200, 0.0], [1e-200, 1e-200], [6.0, 8.0]])
    assert neighbours.cosines(a, b) == pytest.approx([0.5**0.5, 0.5**0.5, 1.0])
