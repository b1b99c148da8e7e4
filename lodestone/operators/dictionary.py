"""Which entries of a dictionary occur in texts, by Aho-Corasick automata: one pass over a text finds all of them at once.

A dictionary of up to SHARD_BYTES (counted first) goes to every executor, and texts stay where they are. A larger one is dealt into
shards of that size by hash, texts into blocks of BLOCK_BYTES, and every shard meets every block in a group of its own; so memory is bounded by
a shard and a block, whatever the dictionary's size, and no row is made for parts of words. Entries and texts are compared as they are given;
null and empty entries and texts match nothing; an entry that occurs several times in a text is given once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import stored

SHARD_BYTES, BLOCK_BYTES = 8 << 20, 64 << 20
ENTRY_BYTES = 16  # of an entry besides its text


def automaton(entries: Iterable[str]) -> ahocorasick.Automaton | None:
    """Finds all entries; None if there are none."""
    found = ahocorasick.Automaton()
    for e in entries:
        if e:
            found.add_word(e, e)
    if not len(found):
        return None
    found.make_automaton()
    return found


def occurring(texts: DataFrame, entries: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, entry) of texts(id, text) and entries(entry): the distinct entries that each text holds."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, entry string"
    known = stored(entries.where("entry != ''").select("entry").distinct(), "dictionary")
    size = known.agg(F.coalesce(F.sum(F.octet_length("entry") + ENTRY_BYTES), F.lit(0))).first()[0]
    rows = texts.where("text != ''").select("id", "text")

    def held(finder: ahocorasick.Automaton | None, table: pa.RecordBatch | pa.Table) -> tuple[list, list]:
        ids, words = [], []
        for i, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True) if finder else ():
            own = {e for _, e in finder.iter(text)}
            ids += [i] * len(own)
            words += sorted(own)
        return ids, words

    def pack(table: pa.RecordBatch | pa.Table, ids: list, words: list) -> list[pa.Array]:
        return [pa.array(ids, table.schema.field("id").type), pa.array(words, pa.string())]

    if size <= shard_bytes:
        shared = texts.sparkSession.sparkContext.broadcast([r[0] for r in known.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = automaton(shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(pack(batch, *held(finder, batch)), ["id", "entry"])

        return rows.mapInArrow(run, schema)
    shards = -(-size // shard_bytes)
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // BLOCK_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = known.select((F.pmod(F.xxhash64("entry"), F.lit(shards))).cast("int").alias("shard"), every(blocks).alias("block"), "entry")
    b = rows.select(every(shards).alias("shard"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text")

    def meet(words: pa.Table, table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(pack(table, *held(automaton(words.column("entry").to_pylist()), table)), names=["id", "entry"])

    return a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInArrow(meet, schema)
