"""Inverted file over vectors: near ones are found in a few lists, by short codes, and scored exactly.

Fitting, on at most SAMPLE vectors (those of smallest hash): spherical k-means gives the lists' centres; what is left of a vector
after its centre is quantised to a byte for each dimension. ``probes``, how many lists a query looks into, is the least number with
which a held-out quarter of the sample would find a share of AIM of its own nearest. Every vector is stored in
the list of its nearest centre, in folders by list.

A search for one query reads the codes of the probed lists only, keeps the SHORT * k best by their codes, and scores these by the stored
vectors. With all lists probed and codes that tell the k best from the others it gives the exact rows. When many queries are searched at
once, lists are split into blocks of BLOCK vectors, and every vector of a block is scored that can be among the k best by its code
and by how far this is from the vector: with all lists probed the rows are exact, whatever the number of copies. Null vectors, those of another width and those without a direction
aren't found; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.operators import retrieval as R
from lodestone.sources.indexes import kept
from lodestone.sources.shared import stored

LAYOUT = 1  # of the stored rows: another number makes new indexes
SAMPLE, SAMPLE_ROWS = 8192, 32  # sampled vectors at most, and of a list at least
LISTS = 256
ROUNDS = 12
AIM = 0.95
SHORT = 10
BLOCK = 16_384


@dataclass(frozen=True)
class Codec:
    """Centres of the lists (unit rows), and how residuals are read from bytes: low + step * code."""

    centres: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int

    def lists_of(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.centres.T).argmax(axis=1)

    def encode(self, units: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((units - self.centres[lists] - self.low) / self.step), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists] + self.low + self.step * codes

    def probed(self, units: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists that each query looks into, nearest first."""
        return np.argsort(-(units @ self.centres.T), axis=1, kind="stable")[:, : min(probes or self.probes, len(self.centres))]


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame  # list, id, code, vector
    codec: Codec


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(sample: np.ndarray, lists: int, k: int = 10, aim: float = AIM, seed: int = 5) -> Codec:
    units, rng = _units(np.asarray(sample, np.float64)), np.random.default_rng(seed)
    held = np.arange(len(units)) % 4 == 3 if len(units) >= 4 * SAMPLE_ROWS else np.zeros(len(units), bool)
    own = units[~held]
    lists = max(1, min(lists, len(own) // SAMPLE_ROWS))
    centres = own[rng.choice(len(own), lists, replace=False)]
    for _ in range(ROUNDS):
        at = (own @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, own)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    left = own - centres[(own @ centres.T).argmax(axis=1)]
    low, high = left.min(axis=0), left.max(axis=0)
    codec = Codec(centres, low, np.maximum((high - low) / 255, 1e-9), lists)
    if not held.any():
        return codec
    at, asked = codec.lists_of(units), np.flatnonzero(held)
    needed = []
    for some in np.array_split(asked, -(-len(asked) // 512)):
        s = units[some] @ units.T
        s[np.arange(len(some)), some] = -2
        near = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        order = codec.probed(units[some])
        place = np.argsort(order, axis=1)
        needed.append(np.take_along_axis(place, at[near], 1).ravel() + 1)
    return Codec(centres, low, codec.step, int(np.ceil(np.quantile(np.concatenate(needed), aim))))


def vector_index(source: DataFrame, id: str = "vec_id", vector: str = "embedding", lists: int = LISTS) -> VectorIndex:
    """The index of source(id, vector), built once for the files that it reads."""
    v = F.col(vector).cast("array<float>")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = source.where(F.col(id).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id).alias("id"), v.alias("vector"))
    width = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    if width is None:
        raise ValueError("no vectors")
    rows = rows.where(F.size("vector") == width["w"])

    def model() -> DataFrame:
        taken = rows.orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).select("vector").toArrow()
        c = fit(_matrix(taken["vector"].combine_chunks()), lists)
        row = (c.centres.tobytes(), c.low.tobytes(), c.step.tobytes(), c.probes)
        return source.sparkSession.createDataFrame([row], "centres binary, low binary, step binary, probes int").coalesce(1)

    m = kept(source, "vectors-model", model, id=id, vector=vector, lists=lists, layout=LAYOUT).first()
    low = np.frombuffer(m["low"])
    codec = Codec(np.frombuffer(m["centres"]).reshape(-1, len(low)), low, np.frombuffer(m["step"]), m["probes"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _units(_matrix(batch.column("vector")))
                at = codec.lists_of(units)
                codes = [c.tobytes() for c in codec.encode(units, at)]
                yield pa.record_batch([pa.array(at.astype(np.int32)), batch.column("id"), pa.array(codes, pa.binary()), batch.column("vector")], names=["list", "id", "code", "vector"])

    kind = dict(rows.dtypes)["id"]
    build = lambda: rows.mapInArrow(coded, f"list int, id {kind}, code binary, vector array<float>").repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
    return VectorIndex(kept(source, "vectors", build, by=("list",), sort=("id",), id=id, vector=vector, lists=lists, layout=LAYOUT), codec)


def _exact(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each row of one with the same row of the other."""
    return (asked * rows).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((asked * asked).sum(axis=1)))


def search(index: VectorIndex, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(id, score) of the k nearest of one query that its lists hold."""
    asked = np.asarray(query, np.float64)
    codec, lists = index.codec, index.codec.probed(_units(asked[None, :]), probes)[0].tolist()
    near = index.rows.where(F.col("list").isin(lists))
    kind = dict(index.rows.dtypes)["id"]

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            score = codec.decode(codes, batch.column("list").to_numpy()) @ (asked / np.sqrt((asked * asked).sum()))
            yield pa.record_batch([batch.column("list"), batch.column("id"), pa.array(score)], names=["list", "id", "guess"])

    short = near.select("list", "id", "code").mapInArrow(guessed, f"list int, id {kind}, guess double").orderBy(F.desc("guess"), "id").limit(SHORT * k)
    both = near.select("list", "id", "vector").join(F.broadcast(short.select("list", "id")), ["list", "id"], "left_semi")  # SHORT * k rows
    return R.vector_stream(both, asked.tolist(), k, "id", "vector")


def search_all(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, rank, id, score) of the k nearest of each of queries(query, vector), the row of its own id left out."""
    codec, kind, asked_kind = index.codec, dict(index.rows.dtypes)["id"], dict(queries.dtypes)["query"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = codec.probed(_units(_matrix(batch.column("vector"))), probes)
                row = np.repeat(np.arange(batch.num_rows), lists.shape[1])
                for low in range(0, len(row), 10_000):
                    part = batch.take(pa.array(row[low : low + 10_000]))
                    yield pa.record_batch([pa.array(lists.ravel()[low : low + 10_000].astype(np.int32)), part.column("query"), part.column("vector")], names=["list", "query", "vector"])

    def met(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            ids, vectors = rows["id"].to_pylist(), _matrix(rows["vector"].combine_chunks())
            near = codec.decode(codes, np.full(len(codes), key[0].as_py()))
            off = np.sqrt(((_units(vectors) - near) ** 2).sum(axis=1)) + 1e-5  # no guess is further from its score
            near = near.astype(np.float32)
            names, wanted = asked["query"].to_pylist(), _matrix(asked["vector"].combine_chunks())
            for low in range(0, len(wanted), 256):
                s = _units(wanted[low : low + 256]).astype(np.float32) @ near.T
                n = min(k + 1, s.shape[1])  # one may be the query's own row
                sure = -np.partition(off - s, n - 1, axis=1)[:, n - 1]  # so near are k others at least
                for r in range(len(s)):
                    short = np.flatnonzero(s[r] + off >= sure[r])
                    score = _exact(np.broadcast_to(wanted[low + r], (len(short), wanted.shape[1])), vectors[short])
                    top = score >= -np.partition(-score, n - 1)[n - 1]
                    best = sorted(((-x, ids[j]) for x, j in zip(score[top].tolist(), short[top].tolist(), strict=True) if ids[j] != names[low + r]))[:k]
                    out += [(names[low + r], i, -x) for x, i in best]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        types = (asked.schema.field("query").type, rows.schema.field("id").type, pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "id", "score"), columns, types, strict=True)})

    probing = stored(queries.select("query", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(dealt, f"list int, query {asked_kind}, vector array<double>"), "vectors-probes")
    n = {r[0]: r[1] for r in index.rows.groupBy("list").count().collect()}  # LISTS rows
    m = {r[0]: r[1] for r in probing.groupBy("list").count().collect()}
    blocks = lambda c: F.element_at(F.array(*(F.lit(max(1, -(-c.get(p, 0) // BLOCK))) for p in range(len(codec.centres)))), F.col("list") + 1)
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    a = index.rows.where(F.col("list").isin(list(m))).select("list", F.pmod(F.xxhash64("id"), blocks(n)).cast("int").alias("a"), every(m).alias("b"), "id", "code", "vector")
    b = probing.select("list", every(n).alias("a"), F.pmod(F.xxhash64("query"), blocks(m)).cast("int").alias("b"), "query", "vector")
    found = a.groupBy("list", "a", "b").cogroup(b.groupBy("list", "a", "b")).applyInArrow(met, f"query {asked_kind}, id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("rank").cast("long").alias("rank"), "id", "score")
