"""Index of trigrams: names that resemble a query, or hold it.

A posting row is one trigram, one class of sizes (numbers of trigrams within a factor of two), and the names of a chunk that have both, each with its own
number. Rows are kept in folders by the hash of their trigram. A name shares c trigrams with a query of q, so with n of its own its similarity
is c / (n + q - c): the postings of the query's trigrams give c by counting, and no name is read.

A name of similarity s or more has between s * q and q / s trigrams, so rows of other sizes are skipped where they lie. For a substring, a name must have all
trigrams inside the query's words; names found so are confirmed by reading them. Queries without a word of three
letters read all names, as nothing can be known from trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.sources.indexes import kept

LAYOUT = 3  # of the stored rows: another number makes new indexes
CHUNK, CHUNKS = 65_536, 64  # names of a chunk, chunks of a folder in one file
TASK_BYTES = 4 << 20  # of names, of which a task that builds sorts the trigrams


@dataclass(frozen=True)
class GramIndex:
    """postings(folder, gram, size, chunk, names) and how many folders there are."""

    postings: DataFrame
    folders: int

    def rows(self, grams: list[str]) -> DataFrame:
        folders = [_folder(F.lit(g), self.folders) for g in grams]
        return self.postings.where(F.col("folder").isin(folders) & F.col("gram").isin(grams))


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def _size(n: Column) -> Column:
    """The class of a number of trigrams, 1 or more: the place of its highest bit."""
    return F.floor(F.log2(n)).cast("int")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (gram, size, chunk, id, n) to rows with lists of names; a list ends with its batch at the latest."""
    keys = ["gram", "size", "chunk"]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            column = batch.column(k)
            new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)))
        at = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, batch.num_rows).astype(np.int32)), pa.StructArray.from_arrays([batch.column("id"), batch.column("n")], ["id", "n"]))
        yield pa.record_batch([*(batch.column(k).take(pa.array(at)) for k in keys), lists], names=[*keys, "names"])


def gram_index(names: DataFrame, id: str, name: str) -> GramIndex:
    """The index of names(id, name), built once for the files that they come from."""
    n = names.count()
    chunks, folders = max(1, -(-n // CHUNK)), max(8, min(1024, n // 100_000))

    def build() -> DataFrame:
        kind = dict(names.dtypes)[id]
        chunk = F.pmod(F.xxhash64(id), F.lit(chunks)).cast("int")
        rows = names.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(name).alias("name"), chunk.alias("chunk"))
        size = names.agg(F.sum(F.octet_length(F.col(name).cast("string")))).first()[0] or 0
        default = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(-(-size // TASK_BYTES), min(default, -(-16 * size // TASK_BYTES)), 1)
        dealt = rows.repartition(tasks, "chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-tasks // chunks))))
        grams = dealt.select("id", "chunk", T.trigrams(F.col("name")).alias("g"))
        each = grams.select(F.explode("g").alias("gram"), _size(F.size("g")).alias("size"), "chunk", "id", F.size("g").alias("n"))
        # Tasks of bounded size sort the trigrams of their own names; only lists are dealt by folder.
        own = each.sortWithinPartitions("gram", "size", "chunk", "id").mapInArrow(_listed, f"gram string, size int, chunk int, names array<struct<id:{kind},n:int>>")
        return own.select(_folder(F.col("gram"), folders).alias("folder"), "*").repartition("folder", F.floor(F.col("chunk") / CHUNKS))

    return GramIndex(kept(names, "grams", build, by=("folder",), sort=("gram", "size"), id=id, name=name, chunks=chunks, folders=folders, layout=LAYOUT), folders)


def grams_of(query: str) -> list[str]:
    """T.trigrams of a literal."""
    return list(dict.fromkeys(f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", query.lower()) for i in range(len(w) + 1)))


def similar(index: GramIndex, query: str, k: int | None, least: float = R.SIMILARITY) -> DataFrame:
    """(id, score) of the k names of most trigram similarity, ``least`` or more, as retrieval.symbol_stream gives them."""
    grams = grams_of(query)
    if least <= 0:
        raise ValueError("least must be positive")
    q = len(grams)
    low, high = max(1, int(least * q)), int(q / least) + 1
    near = index.rows(grams) if grams else index.postings.where(F.lit(False))
    near = near.where(F.col("size").between(_size(F.lit(low)), _size(F.lit(high)))).select(F.explode("names").alias("x")).select("x.id", "x.n")
    common = near.where(F.col("n").between(low, high)).groupBy("id", "n").agg(F.count("*").alias("c"))
    scored = common.select("id", (F.col("c") / (F.col("n") + q - F.col("c"))).alias("score"))
    return R.top(scored.where(F.col("score") >= least), k)


def may_hold(index: GramIndex, query: str) -> DataFrame | None:
    """(id) of the names that have all trigrams inside the query's words; None if there are none, so that any name may hold the query."""
    grams = list(dict.fromkeys(w[i : i + 3] for w in re.findall("[a-z0-9]+", query.lower()) for i in range(len(w) - 2)))
    if not grams:
        return None
    each = index.rows(grams).select(F.explode("names.id").alias("id"))
    return each.groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") == len(grams)).select("id")


def holding(index: GramIndex, names: DataFrame, query: str, id: str, *columns: str) -> DataFrame:
    """Rows of names of which one of the columns holds the query, whatever the case. index: of the columns together, joined by a blank."""
    ids = may_hold(index, query)
    near = names if ids is None else names.join(ids.withColumnRenamed("id", id), id, "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return near.where(hit)
