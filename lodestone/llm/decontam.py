"""Benchmark decontamination by greedy string tiling.

Words are lower-cased in A-Z. Runs of SEED words shared with the benchmark are the seeds: a
document without one can't hold a tile and is clean. For a document and a benchmark item that
share seeds, tiling repeats: find the longest run of words, unmarked on both sides, that both
have (Karp-Rabin over word hashes, the length searched downwards), mark it, until none of
SEED words is left. Tiles don't overlap and come in any order, so reordered passages count. A
document is contaminated if tiles cover at least COVERAGE of an item's words.

The benchmark is broadcast as sorted arrays if it has at most BROADCAST_WORDS words and
BROADCAST_BYTES bytes (counted first; some 30 bytes of memory a word); a larger one is joined on shuffled seeds. Documents
stay where they are. Both forms give the same rows.

Edge cases: null or short texts have no seeds and are clean; items of fewer than SEED words
are matched as a whole if a document holds their exact words in a row. An empty benchmark
leaves every document clean. Rows that repeat an item_id and its text are one item; an item_id with
several texts is an item for each. An item without an item_id counts like any other, with a null item_id.
The best item is the one of most coverage, then the smallest item_id (null last), then the most tiles. Rows that repeat are each judged. Extra columns are
ignored by judge and kept by drop_contaminated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lodestone.llm.shared import free_names, stored
from lodestone.llm.words import Words, mix, powers_to, slices

SEED = 5
COVERAGE = 0.5
BROADCAST_WORDS, BROADCAST_BYTES = 2_000_000, 20_000_000
#: A verdict; its columns are renamed where documents have columns of these names.
NAMES, KINDS = ("item_id", "coverage", "n_tiles", "n_items"), (LongType(), DoubleType(), IntegerType(), IntegerType())


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin values of all runs of n word hashes (modulo 2**64), from one running sum."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers_to(len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:m]) * down[:m])


def _free(marks: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n unmarked words begin."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return np.flatnonzero(total[n:] - total[:-n] == n)


def _share_run(text: np.ndarray, item: np.ndarray, n: int, free_t: np.ndarray, free_i: np.ndarray) -> bool:
    """Whether both have a wholly unmarked run of the same n words."""
    open_t, open_i = _free(free_t, n), _free(free_i, n)
    return bool(len(open_t) and len(open_i) and np.isin(runs(text, n)[open_t], runs(item, n)[open_i]).any())


def _mark(text: np.ndarray, item: np.ndarray, n: int, free_t: np.ndarray, free_i: np.ndarray) -> list[tuple[int, int, int]]:
    """Mark the equal runs of n unmarked words, in text order, then item order.

    Each run of the text goes to the first run of the item that is still free, so only that one is
    looked at: runs of equal value wait in the item's order, and those that a mark touched leave it.
    """
    open_t, open_i = _free(free_t, n), _free(free_i, n)
    value_t, value_i = runs(text, n)[open_t], runs(item, n)[open_i]
    hit = np.isin(value_t, value_i)
    order = np.argsort(value_i, kind="stable")
    value_i, open_i = value_i[order], open_i[order]
    low = np.searchsorted(value_i, value_t[hit]).tolist()
    waiting: dict[int, int] = {}  # first place of a value -> the next one to try
    found, after = [], 0
    for t, first in zip(open_t[hit].tolist(), low, strict=True):
        if t < after:  # a mark set in this call covers its start
            continue
        k = waiting.get(first, first)
        while k < len(open_i) and value_i[k] == value_i[first]:
            i = int(open_i[k])
            if not (free_i[i] and free_i[i + n - 1]):  # marks are n words or more, so they touch an end
                k += 1
                continue
            if (text[t : t + n] == item[i : i + n]).all():
                free_t[t : t + n] = free_i[i : i + n] = False
                found.append((t, i, n))
                after, k = t + n, k + 1
            break
        waiting[first] = k
    return found


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(text position, item position, length) of the greedy tiles, the longest first; equal
    lengths in text order, then item order."""
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    found = []
    high = min(len(text), len(item))
    while high >= least:
        # The longest common run: a run of n words has one of n - 1, so lengths can be bisected.
        low, best = least, 0
        while low <= high:
            n = (low + high) // 2
            if _share_run(text, item, n, free_t, free_i):
                best, low = n, n + 1
            else:
                high = n - 1
        if not best:
            break
        found += _mark(text, item, best, free_t, free_i)
        high = best - 1  # all runs of that length are used up
    return found


def _judge_pair(text: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    got = tiles(text, item, min(SEED, len(item)))
    return sum(n for _, _, n in got) / len(item), len(got)


class _Index:
    """Benchmark items by their seeds: word hashes of all items in a row, and for each seed length
    the sorted seeds with the item of each."""

    def __init__(self, items: list[tuple[int | None, str]]):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.hashes, self.first = words.hashes(), words.first
        self.seeds, self.gate = {}, {}
        for n in range(1, SEED + 1):
            at, value = _own_runs(words, self.hashes, n)
            if not len(at):
                continue
            item = words.row[at].astype(np.int32)
            order = np.lexsort((item, value))
            value, item = value[order], item[order]
            once = np.ones(len(value), bool)
            once[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
            self.seeds[n] = value[once], item[once]
            self.gate[n] = np.zeros(1 << 20, bool)
            self.gate[n][(value >> np.uint64(44)).astype(np.int64)] = True

    def item(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]

    def hits(self, words: Words, h: np.ndarray) -> list[tuple[int, int]]:
        """(text index, item) of all that share a seed, in order."""
        pairs = [np.zeros(0, np.int64)]
        for n, (seeds, item) in self.seeds.items():
            at, value = words.windows(h, n)
            near = self.gate[n][(value >> np.uint64(44)).astype(np.int64)]
            key, value = words.row[at[near]], value[near]
            low, high = np.searchsorted(seeds, value, "left"), np.searchsorted(seeds, value, "right")
            count = high - low
            place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            pairs.append(np.unique(np.repeat(key, count) * len(self.ids) + item[place]))
        both = np.unique(np.concatenate(pairs))
        return list(zip((both // len(self.ids)).tolist(), (both % len(self.ids)).tolist(), strict=True)) if self.ids else []


def _own_runs(words: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of an item's seeds of n words: all runs of SEED, or a shorter item as a whole."""
    at, value = words.windows(h, n)
    if n < SEED:
        whole = words.counts[words.row[at]] == n
        at, value = at[whole], value[whole]
    return at, value


def judge(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, n_tiles, n_items) of each row of documents.

    item_id: the item covered most, null if no seed is shared; n_items: items covered enough.
    """
    judged, _ = _with_verdict(documents.select("doc_id", "text"), benchmark, broadcast_words, ("text",))
    return judged.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), *NAMES)


def _with_verdict(documents: DataFrame, benchmark: DataFrame, broadcast_words: int, without: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """documents with their verdicts, and the names of these."""
    names = free_names(documents.columns, *NAMES)
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    n_words, n_bytes = items.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.sum(F.octet_length("text"))).first()
    if (n_words or 0) > broadcast_words or (n_bytes or 0) > BROADCAST_BYTES:
        return _by_shuffle(documents, items, without, names), names
    index_of = spark.sparkContext.broadcast(_Index([tuple(r) for r in items.orderBy("item_id", "text").collect()]))
    kept = [x for x in documents.columns if x not in without]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for part, words in slices(batches):
            h = words.hashes()
            scores = defaultdict(list)
            for r, k in index.hits(words, h):
                coverage, n = _judge_pair(h[words.first[r] : words.first[r + 1]], index.item(k))
                item = index.ids[k]
                scores[r].append((coverage, item is not None, -(item or 0), n, item))
            best = [(None, 0.0, 0, 0)] * part.num_rows
            for r, found in scores.items():
                coverage, _, _, n, item = max(found, key=lambda x: x[:4])
                best[r] = (item, coverage, n, sum(x[0] >= COVERAGE for x in found))
            columns = [pa.array(x, t) for x, t in zip(zip(*best, strict=True), (pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), *columns], [*kept, *names])

    return documents.mapInArrow(judged, StructType([*(documents.schema[x] for x in kept), *map(StructField, names, KINDS)])), names


def _seeds(texts: DataFrame, key: str, lengths: list[int] | None = None) -> DataFrame:
    """(key, length, seed) of each distinct run of so many words; without lengths, of each
    text's own: SEED words, or all that it has."""
    kind = texts.schema[key]

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches):
            h = words.hashes()
            for n in lengths or range(1, SEED + 1):
                at, value = words.windows(h, n) if lengths else _own_runs(words, h, n)
                ids = part.column(key).take(pa.array(words.row[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), n, np.int32)), pa.array(value.view(np.int64))], [key, "length", "seed"])

    return texts.select(key, "text").mapInArrow(seeded, StructType([kind, StructField("length", IntegerType()), StructField("seed", LongType())])).distinct()


def _by_shuffle(documents: DataFrame, items: DataFrame, without: tuple[str, ...], names: list[str]) -> DataFrame:
    """The same verdicts for a benchmark of any size: (text, item) pairs that share a seed are
    joined on it, then tiled. Texts go by their digest, so copies are tiled once."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    texts = stored(documents.select(digest("text").alias("digest"), "text").where("text is not null").dropDuplicates(["digest"]), "decontam-texts")
    items = stored(items.withColumn("item", digest("text")), "decontam-items")
    wording = items.select("item", "text").dropDuplicates(["item"])
    of_items = stored(_seeds(wording, "item"), "decontam-seeds")
    lengths = sorted(r[0] for r in of_items.select("length").distinct().collect())  # SEED of them at most
    if not lengths:
        lengths = [SEED]
    pairs = stored(_seeds(texts, "digest", lengths).join(of_items, ["length", "seed"]).select("digest", "item").distinct(), "decontam-pairs")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches):
            other = Words(part.column("wording"))
            h, g = words.hashes(), other.hashes()
            scores = [_judge_pair(h[words.first[r] : words.first[r + 1]], g[other.first[r] : other.first[r + 1]]) for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("item"), pa.array([s[0] for s in scores], pa.float64()), pa.array([s[1] for s in scores], pa.int32())], ["digest", "item", "coverage", "n_tiles"])

    both = pairs.join(wording.withColumnRenamed("text", "wording"), "item").join(texts, "digest")
    scored = both.select("digest", "item", "text", "wording").mapInArrow(tiled, "digest string, item string, coverage double, n_tiles int")
    scored = scored.join(items.select("item", "item_id"), "item")
    own, other = free_names([*documents.columns, *names], "of_text", "of_best")
    best = scored.groupBy("digest").agg(F.max(F.struct("coverage", F.col("item_id").isNotNull(), -F.col("item_id"), "n_tiles", "item_id")).alias("b"), F.sum((F.col("coverage") >= COVERAGE).cast("int")).cast("int").alias("n"))
    best = best.select(F.col("digest").alias(other), *(c.alias(n) for c, n in zip((F.col("b.item_id"), F.col("b.coverage"), F.col("b.n_tiles"), F.col("n")), names, strict=True)))
    out = documents.withColumn(own, digest("text")).drop(*without).join(best, F.col(own) == F.col(other), "left").drop(own, other)
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast(t)) for n, t in zip(names[1:], KINDS[1:], strict=True)})


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """documents that no benchmark item covers enough, with their own columns, whatever their names."""
    judged, names = _with_verdict(documents, benchmark, broadcast_words, ())
    return judged.where(F.col(names[-1]) == 0).drop(*names)
