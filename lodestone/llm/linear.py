"""Logistic regression on hashed word features, trained by FTRL-proximal updates.

Features are counted, so a score is a sparse dot product: the weights of a text's features
times a damped count, plus a bias. Training reads a bounded sample (``max_rows``) of labelled
rows; scoring reads every whole text and needs only the few non-zero weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.sampling import MAX_BYTES, bounded, one_text
from lodestone.llm.words import SPACED, Words, mix, slices

Features = Callable[[Words], list[tuple[np.ndarray, np.ndarray]]]


def counted(words: Words, features: Features, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, count) of each text's hashed features, sorted by both."""
    keys = []
    for kind, (rows, h) in enumerate(features(words)):
        bucket = mix(h + np.uint64(kind)) >> np.uint64(64 - bits)
        keys.append((rows.astype(np.uint64) << np.uint64(bits)) | bucket)
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int32), count


def damped(count: np.ndarray) -> np.ndarray:
    return np.log1p(count).astype(np.float64)


@dataclass
class Model:
    bucket: np.ndarray  # sorted buckets that have a weight
    weight: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << self.bits)
        full[self.bucket] = self.weight
        return full


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int = 7) -> Model:
    """rows: (label, buckets, counts). FTRL-proximal: a learning rate for each coordinate from
    its own squared gradients, weights recovered lazily with L1 soft thresholding. The bias is
    a coordinate without L1. Rows are visited in an order drawn from the seed.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - penalty[i], 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            label, bucket, count = rows[r]
            i, x = np.append(bucket, size), np.append(damped(count), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    w = weights(np.arange(size + 1))
    used = np.flatnonzero(w[:size])
    return Model(used, w[used], float(w[size]), bits)


def sample(texts: DataFrame, labels: DataFrame, label: str, features: Features, bits: int, max_rows: int, inside: np.ndarray = SPACED, max_bytes: int = MAX_BYTES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of at most max_rows labelled texts: those with the smallest hash of their id, as far
    as their features fit into max_bytes.

    The drawn ids are the only broadcast, at most max_rows of them. Rows of null label or
    without a text row are left out; of a doc_id with several texts one is learnt from.
    """
    drawn = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = one_text(texts.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches, inside=inside):
            row, bucket, count = counted(words, features, bits)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            cut = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array([bucket[c].tobytes() for c in cut], pa.binary()), pa.array([np.minimum(count[c], 65535).astype(np.uint16).tobytes() for c in cut], pa.binary())],
                ["doc_id", "label", "bucket", "count"],
            )

    found = rows.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label int, bucket binary, count binary")
    found = bounded(found, F.octet_length("bucket") + F.octet_length("count"), max_bytes)
    out = []
    for batch in found.toArrow().to_batches():
        ids, y = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
        # Views of Arrow's own memory: the sample is held once.
        buckets, counts = (_views(batch.column(c), t) for c, t in (("bucket", np.int32), ("count", np.uint16)))
        out += zip(ids, y, buckets, counts, strict=True)
    out.sort(key=lambda r: (r[0] is not None, r[0]))
    return [r[1:] for r in out]


def _views(column: pa.Array, kind: type) -> list[np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [whole[a:b].view(kind) for a, b in zip(at[:-1], at[1:], strict=True)]


def append_score(texts: DataFrame, model: Model, features: Features, inside: np.ndarray = SPACED, name: str = "score", without: tuple[str, ...] = ()) -> DataFrame:
    """The rows of texts, without some columns, with the score of their text as one more."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = model.dense()
        for part, words in slices(batches, inside=inside):
            row, bucket, count = counted(words, features, model.bits)
            w = dense[bucket]
            hit = w != 0
            total = np.bincount(row[hit], w[hit] * damped(count[hit]), part.num_rows) + model.bias
            value = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), value], [*kept, name])

    kept = [x for x in texts.columns if x not in without]
    schema = StructType([*(texts.schema[x] for x in kept), StructField(name, DoubleType())])
    return texts.mapInArrow(scored, schema)


def score(texts: DataFrame, model: Model, features: Features, inside: np.ndarray = SPACED) -> DataFrame:
    """(doc_id, score) of every text; null and empty texts get the bias alone."""
    return append_score(texts.select("doc_id", "text"), model, features, inside, without=("text",))
