"""Source divergence audit: how far the word use of a language's sources is from each other's.

Terms are runs of letters (A-Z, a-z, everything beyond ASCII), lower-cased in A-Z. A language keeps the
terms that occur in at least MIN_DOCS of its documents. Each group (lang, source), and each language
as a whole, gives a kept term the smoothed share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))
in integers, V the number of the language's kept terms and N the group's occurrences of them.

Method: one pass counts terms by group. The counts are sorted by (lang, term), so that a task has all groups of
a run of terms; it keeps the sorted array of the terms that are frequent enough, and a term's place in it is its integer id.
Rows are encoded as ids, and each group of a chunk of at most CHUNK ids becomes one dense vector of counts. Ids and chunks
follow the UTF-8 order of terms, so ties need no strings. Distances and top terms are numpy sums over these vectors.

Scale: counts are combined in each task before their shuffle, then by (lang, source, term), so a word of every text costs
one row a task. No vocabulary is broadcast or collected: it is cut into chunks by range. Vectors of one chunk
are compared in blocks of SOURCES sources; the result of part ``pair`` itself has a row for each ordered pair
of sources. Vectors hold a chunk's zeros too: (sources of a language) x (its kept terms) numbers in all.

Edge cases: null text, lang and source count as ''. Every row is a document, rows that repeat a doc_id included. A
group without terms has counts of 0 everywhere; a language without kept terms has pairs of value 0 and no terms. An
empty table gives no rows. Equal values are ranked by item in UTF-8 order. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.shared import stored
from lodestone.llm.words import Words, slices

MIN_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP = 50  # ranks of part term
CHUNK = 4096  # ids of a chunk
SOURCES = 256  # sources of a block
COMBINE_ROWS, FLUSH_ROWS = 1_000_000, 500_000  # of a task's table of counts
KEPT_ROWS = 1_000_000  # rows that a chunk is made of, unless a single term has more

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

COUNTS = "lang string, source string, term string, n_docs long, n long"
VECTORS = "lang string, chunk string, source string, terms array<string>, counts array<long>"


def terms_of(words: Words) -> pa.StringArray:
    """The words as strings, lower-cased in A-Z: their bytes stand one after the other once all others are left out."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.end - words.start, out=at[1:])
    data = _FOLD[words.data[words.solid]]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(at), pa.py_buffer(data))


def _combined(parts: list[pa.Table]) -> pa.Table:
    keys = ["group", "term"]
    return pa.concat_tables(parts).group_by(keys).aggregate([("n_docs", "sum"), ("n", "sum")]).select([*keys, "n_docs_sum", "n_sum"]).rename_columns([*keys, "n_docs", "n"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS; every group also has a row of the empty term. A task's groups are numbered while it counts."""
    schema = pa.schema([("group", pa.int32()), ("term", pa.large_string()), ("n_docs", pa.int64()), ("n", pa.int64())])
    numbers: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1))
        for batch in table.to_batches(max_chunksize=20_000):
            group = batch.column("group")
            yield pa.record_batch([lang.take(group), source.take(group), batch.column("term").cast(pa.string()), batch.column("n_docs"), batch.column("n")], names=["lang", "source", "term", "n_docs", "n"])

    for part, words in slices(batches, inside=_LETTER):
        names = part.select(["lang", "source"]).to_pylist()
        group = np.array([numbers.setdefault((r["lang"], r["source"]), len(numbers)) for r in names], np.int64)
        term = terms_of(words).dictionary_encode()
        code, n_terms = np.asarray(term.indices, np.int64), max(1, len(term.dictionary))
        row = words.row
        by_doc = np.unique(row * n_terms + code)  # each text's terms once
        docs = group[by_doc // n_terms] * n_terms + by_doc % n_terms
        key, n = np.unique(group[row] * n_terms + code, return_counts=True)
        n_docs = np.bincount(np.searchsorted(key, docs), minlength=len(key)).astype(np.int64)
        held.append(pa.table([pa.array((key // n_terms).astype(np.int32)), term.dictionary.take(pa.array(key % n_terms)), pa.array(n_docs), pa.array(n.astype(np.int64))], schema=schema))
        own = np.unique(group).astype(np.int32)
        zero = pa.array(np.zeros(len(own), np.int64))
        held.append(pa.table([pa.array(own), pa.array([""] * len(own), pa.large_string()), zero, zero], schema=schema))
        rows += len(key) + len(own)
        if rows > COMBINE_ROWS:
            held = [_combined(held)]
            rows = held[0].num_rows
            if rows > FLUSH_ROWS:
                yield from out(held[0])
                held, rows = [], 0
                numbers.clear()
    if held:
        yield from out(_combined(held))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n_docs, n): documents and occurrences of each term in each group; every group has the empty term with 0."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    found = documents.select(text, lang, source).mapInArrow(counted, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def encoder(min_docs: int = MIN_DOCS, size: int = CHUNK, most_rows: int = KEPT_ROWS):
    """Sorted rows (lang, term, source, n_docs, n) to rows of VECTORS: one of each chunk (null source) with its terms and
    total counts, and one of each of its groups with the counts in the order of the terms."""

    def chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: of one language and at most ``size`` kept terms."""
        terms = rows["term"].combine_chunks()
        new = np.ones(len(terms), bool)
        new[1:] = np.asarray(pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)))
        kept = terms.filter(pa.array(new))  # sorted, so a term's id is its place
        ids = np.searchsorted(np.flatnonzero(new), np.arange(len(terms)), "right") - 1
        n = np.asarray(rows["n"], np.int64)
        total = np.zeros(len(kept), np.int64)
        np.add.at(total, ids, n)
        lang, name = rows["lang"][0].as_py(), kept[0].as_py()
        schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
        yield pa.record_batch([[lang], [name], [None], pa.array([kept.to_pylist()], schema.field("terms").type), pa.array([total])], schema=schema)
        sources = rows["source"].combine_chunks().dictionary_encode()
        code = np.asarray(sources.indices, np.int64)
        order = np.argsort(code, kind="stable")
        cut = np.searchsorted(code[order], np.arange(len(sources.dictionary) + 1))
        for low in range(0, len(sources.dictionary), SOURCES):
            some = sources.dictionary.slice(low, SOURCES)
            mine = order[cut[low] : cut[low + len(some)]]
            dense = np.bincount((code[mine] - low) * len(kept) + ids[mine], minlength=len(some) * len(kept))
            dense[(code[mine] - low) * len(kept) + ids[mine]] = n[mine]  # a group has one row a term
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(kept), pa.int32()), pa.array(dense.astype(np.int64)))
            yield pa.record_batch([[lang] * len(some), [name] * len(some), some, pa.nulls(len(some), schema.field("terms").type), lists], schema=schema)

    def frequent(rows: pa.Table) -> pa.Table:
        """Of whole terms, the rows of those in enough documents, with the number of the term."""
        lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
        new = np.ones(len(term), bool)
        new[1:] = np.asarray(pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(term.slice(1), term.slice(0, len(term) - 1))))
        at = np.flatnonzero(new)
        enough = np.add.reduceat(np.asarray(rows["n_docs"], np.int64), at) >= min_docs
        return rows.filter(pa.array(np.repeat(enough, np.diff(np.append(at, len(term))))))

    def starts(rows: pa.Table, *keys: str) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            column = rows[k].combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.Table] = []  # the last term's may not be complete
        kept: list[pa.Table] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept
            rows = pa.concat_tables(kept) if kept else None
            while rows is not None and rows.num_rows:
                at = starts(rows, "lang", "term")
                lang_end = np.append(starts(rows, "lang"), rows.num_rows)[1]
                n_terms = int(np.searchsorted(at, lang_end))
                whole = lang_end < rows.num_rows or last or n_terms > size or rows.num_rows > most_rows
                if not whole:
                    break
                n_terms = min(n_terms, size, max(1, int(np.searchsorted(at, most_rows))))
                end = int(at[n_terms]) if n_terms < len(at) else rows.num_rows
                yield from chunk(rows.slice(0, end))
                rows = rows.slice(end)
            kept = [rows] if rows is not None and rows.num_rows else []

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            open_rows.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held < 200_000:
                continue
            rows = pa.concat_tables(open_rows)
            end = int(starts(rows, "lang", "term")[-1])
            open_rows, held = [rows.slice(end)], rows.num_rows - end
            if end:
                kept.append(frequent(rows.slice(0, end)))
                yield from cut(False)
        if open_rows:
            kept.append(frequent(pa.concat_tables(open_rows)))
        yield from cut(True)

    return run


def encoded(counts: DataFrame, min_docs: int = MIN_DOCS, size: int = CHUNK) -> DataFrame:
    """Rows of VECTORS from counts(lang, source, term, n_docs, n). A chunk is named by its first term."""
    rows = counts.where("term != ''").select("lang", "term", "source", "n_docs", "n")
    return rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(encoder(min_docs, size), VECTORS)


def shares(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exact for denominators up to 9e15: SCALE is 1000 three times, and each step divides."""
    below = np.asarray(n, np.int64) + SMOOTH * v
    whole, rest = np.divmod(count + SMOOTH, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def distances(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of one chunk's groups: (lang, source, item, value) of every pair, both ways, summed over the chunk."""
    rows = pa.Table.from_batches(list(batches))
    side, size, n, v = (np.asarray(rows[c], np.int64) for c in ("side", "size", "n", "v"))
    dense = np.zeros((len(size), int(size[0])), np.int64)
    for k, counts in enumerate(rows["counts"].combine_chunks()):
        if counts.is_valid:
            dense[k] = counts.values.to_numpy()
    p = shares(dense, n[:, None], int(v[0]))
    names = rows["source"].combine_chunks()
    own = bool(rows["own"][0].as_py())
    right = np.flatnonzero(side == (0 if own else 1))
    a, b, value = [], [], []
    for left in np.flatnonzero(side == 0):
        others = right[right > left] if own else right
        if len(others):
            d = np.abs(p[others] - p[left]).sum(axis=1)
            for x, y in ((np.full(len(others), left), others), (others, np.full(len(others), left))):
                a.append(x), b.append(y), value.append(d)
    if a:
        x, y, d = map(np.concatenate, (a, b, value))
        lang = rows["lang"][0].as_py()
        yield pa.record_batch([pa.array([lang] * len(x)), names.take(pa.array(x)), names.take(pa.array(y)), pa.array(d)], names=["lang", "source", "item", "value"])


def tops(top: int = TOP):
    """Vectors with their chunk's terms and totals to the first ``top`` (lang, source, item, value) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source, item, value = [], [], [], []
            for r in range(batch.num_rows):
                counts, total = (batch.column(c)[r].values.to_numpy() for c in ("counts", "total"))
                n, v, all_n = (batch.column(c)[r].as_py() for c in ("n", "v", "all_n"))
                f = shares(counts, n, v) - shares(total, all_n, v)
                ids = np.flatnonzero((counts > 0) & (f > 0))
                ids = ids[np.lexsort((ids, -f[ids]))[:top]]
                item += batch.column("terms")[r].values.take(pa.array(ids)).to_pylist()
                value += f[ids].tolist()
                lang += [batch.column("lang")[r].as_py()] * len(ids)
                source += [batch.column("source")[r].as_py()] * len(ids)
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    return run


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, size: int = CHUNK, block: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks each other source of the language by distance, part
    ``term`` the terms that the group uses more than its language, at most ``top``."""
    counts = stored(term_counts(documents), "divergence-counts")
    vectors = stored(encoded(counts, min_docs, size), "divergence-vectors")
    chunks = vectors.where("source IS NULL").select("lang", "chunk", "terms", F.col("counts").alias("total"), F.size("terms").alias("size"))
    groups = vectors.where("source IS NOT NULL").select("lang", "chunk", "source", "counts")
    sizes = chunks.groupBy("lang").agg(F.sum("size").cast("long").alias("v"), F.sum(F.aggregate("total", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all_n"))
    used = groups.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    names = counts.where("term = ''").select("lang", "source")
    blocks = names.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    members = names.join(used, ["lang", "source"], "left").join(blocks, "lang").join(sizes, "lang", "left")
    nothing = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    members = stored(members.select("lang", "source", nothing("n"), nothing("v"), nothing("all_n"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")), "divergence-members")

    # Every group of the language in every chunk, then each block beside each block not before it.
    grid = chunks.select("lang", "chunk", "size").join(members, "lang").join(groups, ["lang", "chunk", "source"], "left")
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))))
    dealt = grid.select("*", pairs.alias("p")).select("lang", "chunk", "source", "counts", F.col("size").cast("long").alias("size"), "n", "v", "p.x", "p.y", (F.col("block") == F.col("p.x")).alias("first"), (F.col("p.x") == F.col("p.y")).alias("own"))
    dealt = dealt.select("*", F.when(F.col("first"), 0).otherwise(1).cast("long").alias("side")).drop("first")
    part = dealt.groupBy("lang", "chunk", "x", "y").applyInArrow(distances, "lang string, source string, item string, value long")
    far = part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = members.select("lang", F.col("source").alias("item"))
    pair = members.select("lang", "source").join(other, "lang").where("source != item").join(far, ["lang", "source", "item"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", nothing("value"))

    listed = groups.join(chunks, ["lang", "chunk"]).join(members.select("lang", "source", "n", "v", "all_n"), ["lang", "source"])
    term = listed.select("lang", "source", "terms", "counts", "total", "n", "v", "all_n").mapInArrow(tops(top), "lang string, source string, item string, value long")
    term = term.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
