"""Approximate nearest neighbours with learned partitions.

Fitting, on a bounded sample of distinct vectors (SAMPLE of them, or as many as SAMPLE_BYTES hold, those of smallest
hash; a quarter is held out): the graph of each vector's NEAR nearest neighbours is cut into up to PARTS parts of equal size, by
halving it again and again along its slowest mode and swapping vectors while that cuts fewer edges. A softmax classifier
then learns, for a vector, the distribution of parts among itself and its neighbours. A query is routed to its most
probable parts until their probabilities add up to the model's ``mass``; that is the least mass with which held-out vectors would
find a share of AIM of their own nearest neighbours.

Index: every vector goes into its most probable part; of equal vectors only those of the KEPT smallest ids are kept,
which are all that a query can return. Search: queries meet the vectors of their parts in blocks. Matrix products in
single precision propose, for each query, all vectors within MARGIN of the best; these are scored again in
double precision, each pair by itself, so that equal vectors have equal scores wherever they are.

The method finds what lies in the probed parts. Where vectors have near neighbours a query probes few of its parts; where
they are spread evenly in all directions no partition can separate near from far, and the calibrated mass
makes it probe more than half of them. README has the recall and the share of rows compared.

Scale: the model has PARTS x (dimension + 1) numbers. Parts are split by hash into blocks of BLOCK vectors and of BLOCK
queries, so a part that holds a third of all rows is many tasks. Equal queries are searched once. Each block
gives the KEPT best of each query, and these are cut again before they are shuffled.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id.
Vectors have one length, the one that most rows have (of equally many, the longest); others take no part. Rows that repeat
a vec_id are rows of their own and candidates of each other; equal queries are answered once. Scores that are equal are
ranked by vec_id. A query has fewer than ``k`` neighbours only if there are fewer candidates in all. An empty
table gives no rows. Extra columns are ignored. Components may be of any size: vectors are scaled by a power of two first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.shared import stored

NEIGHBOURS = 5
EVERY = 50  # queries are the rows whose vec_id is divisible by it
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
PARTS = 64
PART_ROWS = 64  # sampled vectors of a part at least
NEAR = 10  # neighbours of a vector in the graph
AIM = 0.98
BLOCK = 16_384
MARGIN = 2e-5  # of a cosine in single precision
SHARP = 8.0  # length of vectors that the classifier reads


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which brings their largest component near 1; nothing is rounded but what is then below 1e-300."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with the same row of b, each summed in the same order."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indexes of the k rows of largest cosine (unit vectors) for each query; own: the row that is the query itself."""
    out = np.empty((len(queries), k), np.int64)
    for low in range(0, len(queries), 512):
        s = queries[low : low + 512] @ rows.T
        if own is not None:
            s[np.arange(len(s)), own[low : low + 512]] = -2
        out[low : low + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(src: np.ndarray, dst: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A set of half of n vertices that cuts few of the edges."""
    sums = lambda x: np.bincount(src, x[dst], n) + np.bincount(dst, x[src], n)
    degree = np.maximum(sums(np.ones(n)), 1e-9)
    mode = rng.standard_normal(n)
    for _ in range(60):  # lazy random walks leave the slowest mode
        mode = mode + sums(mode) / degree
        mode -= (mode * degree).sum() / degree.sum()
        mode /= max(np.linalg.norm(mode), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        here = np.where(side, 1.0, -1.0)
        gain = -here * sums(here)  # neighbours on the other side less those on its own
        a, b = (x[np.argsort(-gain[x], kind="stable")] for x in (np.flatnonzero(side), np.flatnonzero(~side)))
        k = min(len(a), len(b))
        better = int((gain[a[:k]] + gain[b[:k]] > 0).sum())
        if not better:
            break
        swap = max(1, better // 3)
        side[a[:swap]], side[b[:swap]] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """The part of each vertex of graph (the neighbours of each), parts of equal size but for one; parts: a power of two."""
    rng, n = np.random.default_rng(seed), len(graph)
    part, have = np.zeros(n, np.int64), 1
    while have < parts:
        finer = np.empty(n, np.int64)
        for p in range(have):
            mine = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            dst = place[graph[mine]].ravel()
            src = np.repeat(np.arange(len(mine)), graph.shape[1])
            finer[mine] = 2 * p + _halves(src[dst >= 0], dst[dst >= 0], len(mine), rng)
        part, have = finer, 2 * have
    return part


@dataclass
class Router:
    weight: np.ndarray  # dimension x parts
    bias: np.ndarray
    mass: float = 1.0

    @property
    def parts(self) -> int:
        return len(self.bias)

    def probabilities(self, units: np.ndarray) -> np.ndarray:
        x = (units * SHARP).astype(np.float32) @ self.weight + self.bias
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def probed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts by falling probability, probability of those before each)."""
        p = self.probabilities(units)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(p, axis=1) - p


def learned(units: np.ndarray, wanted: np.ndarray, epochs: int = 30, rate: float = 2e-3, seed: int = 7) -> Router:
    """Softmax regression to the distributions ``wanted``, by Adam on batches of 256."""
    rng = np.random.default_rng(seed)
    x = (units * SHARP).astype(np.float32)
    w = [rng.standard_normal((x.shape[1], wanted.shape[1])).astype(np.float32) * 0.01, np.zeros(wanted.shape[1], np.float32)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 256):
            i = order[low : low + 256]
            p = x[i] @ w[0] + w[1]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - wanted[i]) / len(i)
            t += 1
            for k, g in enumerate((x[i].T @ p, p.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def fit(sample: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, aim: float = AIM) -> Router:
    """The router of a sample of distinct vectors, in any order that doesn't depend on them."""
    units = unit(np.asarray(sample, np.float64).reshape(len(sample), -1)).astype(np.float32) if len(sample) else np.zeros((0, 1), np.float32)
    held = np.arange(len(units)) % 4 == 3
    train = units[~held]
    have = 1
    while 2 * have <= min(parts, len(train) // PART_ROWS):
        have *= 2
    if have == 1:
        return Router(np.zeros((units.shape[1], 1), np.float32), np.zeros(1, np.float32))
    graph = nearest(train, train, NEAR, np.arange(len(train)))
    part = balanced_parts(graph, have)
    wanted = np.zeros((len(train), have), np.float32)
    np.add.at(wanted, (np.repeat(np.arange(len(train)), NEAR + 1), np.c_[part, part[graph]].ravel()), 1 / (NEAR + 1))
    router = learned(train, wanted)
    # Held-out vectors look for their nearest in the whole sample, where each is in the part that the router gives.
    home = router.probabilities(units).argmax(axis=1)
    found = nearest(units[held], units, k, np.flatnonzero(held))
    order, before = router.probed(units[held])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(have)[None, :], 1)
    needed = np.take_along_axis(before, np.take_along_axis(place, home[found], 1), 1)
    router.mass = float(np.quantile(needed, aim)) + 1e-6
    return router


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, hash) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("vector") == (lengths["length"] if lengths else 0)).select("vec_id", "vector", F.xxhash64("vector").alias("hash"))


def router_of(rows: DataFrame, parts: int = PARTS, sample: int = SAMPLE, k: int = NEIGHBOURS) -> Router:
    """Fit on at most ``sample`` rows (hash, vector), those of smallest hash."""
    one = rows.first()
    if one is None:
        return fit(np.zeros((0, 1)))
    most = max(1, min(sample, SAMPLE_BYTES // (8 * len(one["vector"]))))
    taken = rows.orderBy("hash", "vector").limit(most).select("vector").toArrow()
    return fit(_vectors(taken["vector"].combine_chunks()), parts, k)


def indexed(rows: DataFrame, router: Router) -> DataFrame:
    """(part, vec_id, vector) of rows(vec_id, vector)."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(unit(_vectors(batch.column("vector")))).argmax(axis=1).astype(np.int32)
                yield pa.record_batch([pa.array(part), batch.column("vec_id"), batch.column("vector")], names=["part", "vec_id", "vector"])

    return rows.select("vec_id", "vector").mapInArrow(homes, "part int, vec_id long, vector array<double>")


def routed(queries: DataFrame, router: Router, sizes: list[int], least: int) -> DataFrame:
    """(part, query, vector) of queries(query, vector) for each part that a query probes: until the router's mass is reached
    and the parts (of ``sizes`` rows) hold ``least`` rows."""
    size = np.array(sizes, np.int64)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order, before = router.probed(unit(_vectors(batch.column("vector"))))
            rows = np.cumsum(size[order], axis=1) - size[order]
            row, at = np.nonzero(((before < router.mass) | (rows < least)) & (size[order] > 0))
            for low in range(0, len(row), 10_000):
                r, a = row[low : low + 10_000], at[low : low + 10_000]
                taken = batch.select(["query", "vector"]).take(pa.array(r))
                yield pa.record_batch([pa.array(order[r, a].astype(np.int32)), *taken.columns], names=["part", "query", "vector"])

    return queries.select("query", "vector").mapInArrow(probes, "part int, query long, vector array<double>")


def searched(kept: int):
    """A block of vectors and a block of queries to the ``kept`` best (query, vec_id, score) of each query."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            rows, asked = _vectors(vectors["vector"].combine_chunks()), _vectors(queries["vector"].combine_chunks())
            ids, names = vectors["vec_id"].to_numpy(), queries["query"].to_numpy()
            near, small = unit(rows).astype(np.float32), unit(asked).astype(np.float32)
            for low in range(0, len(asked), 256):
                s = small[low : low + 256] @ near.T
                best = np.partition(s, -kept, axis=1)[:, -kept] if len(rows) > kept else np.full(len(s), -2, np.float32)
                q, r = np.nonzero(s >= best[:, None] - np.float32(MARGIN))
                score = cosines(asked[low + q], rows[r])
                order = np.lexsort((ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                keep = place < kept
                for c, x in (("query", names[low + q[keep]]), ("vec_id", ids[r[keep]]), ("score", score[keep])):
                    out[c].append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t) for (c, x), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()))})

    return run


def search(index: DataFrame, queries: DataFrame, router: Router, kept: int, block: int = BLOCK) -> DataFrame:
    """(query, vec_id, score): the ``kept`` best of each of queries(query, vector) in index(part, vec_id, vector)."""
    counts = lambda df: dict(map(tuple, df.groupBy("part").agg(F.count("*")).collect()))  # noqa: E731  (a row for each part)
    have = counts(index)
    probes = stored(routed(queries, router, [have.get(p, 0) for p in range(router.parts)], kept), "neighbours-probes")
    asked = counts(probes)
    blocks = lambda n: F.element_at(F.array(*(F.lit(max(1, -(-n.get(p, 0) // block))) for p in range(router.parts))), F.col("part") + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    a = index.where(F.col("part").isin(list(asked))).select("part", F.pmod(F.xxhash64("vec_id"), blocks(have)).cast("int").alias("a"), every(asked).alias("b"), "vec_id", "vector")
    b = probes.select("part", every(have).alias("a"), F.pmod(F.xxhash64("query"), blocks(asked)).cast("int").alias("b"), "query", "vector")
    keys = ("part", "a", "b")
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(searched(kept), "query long, vec_id long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)


def nearest_neighbours(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, parts: int = PARTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id is divisible by ``every``, the ``k`` nearest other rows found."""
    kept = k + 1  # one may be the query itself
    rows = stored(usable(embeddings), "neighbours-rows")
    copies = W.partitionBy("hash", "vector").orderBy("vec_id")
    few = stored(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= kept), "neighbours-distinct")
    router = router_of(few.where("copy = 1"), parts, sample, k)
    index = stored(indexed(few, router), "neighbours-index")

    asked = rows.where(F.col("vec_id") % every == 0)
    classes = stored(asked.groupBy("hash", "vector").agg(F.min("vec_id").alias("query")), "neighbours-queries")
    best = search(index, classes.select("query", "vector"), router, kept)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.col("place"), "vec_id", "score"))).alias("best"))  # kept rows at most
    each = asked.select("vec_id", "hash", "vector").distinct().join(classes, ["hash", "vector"]).select(F.col("vec_id").alias("query_id"), "query")
    found = each.join(best, "query")
    own = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id")).cast("int")
    others = F.slice(F.filter("best", lambda x, i: i + 1 != own), 1, k)
    return found.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
