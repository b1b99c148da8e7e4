"""Inverted index of words: which documents hold a token, and where.

A posting row is one token in one block of documents: the documents' ids, for each of them the occurrences in each field, and
the token's positions as differences, packed in one to five bytes each. Rows are flat, as a row of nested arrays takes several times the memory to
shuffle and sort. Blocks are the same for all tokens, BLOCK_DOCS documents each by the hash of their id, so
the tokens of a query meet block by block and nothing larger than a block is ever gathered. Rows are kept in folders by the hash of their
token: a query reads the folders of its own tokens and no text. ``most`` is the highest score of a block, so the k best for one
token come from the blocks that can still hold one of them.

Building is one shuffle of the documents by block, and one of the finished postings by folder; a token of every document
is as many rows as there are blocks. Changes make a small index of their own (``with_changes``): the ids they replace are
hidden in the older part. Ids are unique; rows without one aren't found. Scores, ranks and ties are those of
``retrieval.lexical_stream``. The English form reads the same postings: a stem's tokens are looked up among all tokens of
the index, each of which is stemmed once, and function words only move the places of the words behind them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions import text as T
from lodestone.functions.stem import stem
from lodestone.operators import retrieval as R
from lodestone.sources.indexes import kept

LAYOUT = 3  # of the stored rows: another number makes new indexes
BLOCK_DOCS = 1024
FILES = 256  # blocks of a token that lie in one file
TASK_BLOCKS = 8  # blocks' worth of rows in a task that builds, so that its sort fits into memory


@dataclass(frozen=True)
class TokenIndex:
    """postings(folder, token, block, n_docs, n, most, ids, counts, steps); weights: of the fields; hidden: ids that a newer part replaces."""

    postings: DataFrame
    folders: int
    blocks: int
    weights: tuple[float, ...]
    english: bool = False
    hidden: DataFrame | None = None
    newer: TokenIndex | None = None

    def parts(self) -> list[TokenIndex]:
        return [self, *(self.newer.parts() if self.newer else [])]

    def words(self, query: str) -> list[str]:
        found = R.lexemes(query)
        return list(dict.fromkeys(stem(w) for w in found if w not in T.ENGLISH_STOPWORDS)) if self.english else found

    def forms(self, words: list[str]) -> dict[str, str]:
        """Token -> the one of these stems that it has. A stem keeps a word's beginning, so other tokens aren't read, and has no more
        tokens than there are endings."""
        if not self.english:
            return {w: w for w in words}
        # The first two letters (but for dying, lying, tying), as in retrieval.lexical_stream_english.
        near = reduce(Column.__or__, (F.col("token").startswith(w[:1] if w in ("die", "lie", "tie") else w[:2]) for w in words))
        tokens = self.postings.where(near).select("token").distinct()
        return {r["token"]: r["stem"] for r in tokens.mapInArrow(_with_stems, "token string, stem string").where(F.col("stem").isin(words)).collect()}

    def rows(self, words: list[str]) -> DataFrame:
        """The posting rows of these tokens, hidden documents included."""
        # Folders are constants to the optimizer: the reader opens no others.
        folders = [_folder(F.lit(w), self.folders) for w in words]
        return self.postings.where(F.col("folder").isin(folders) & F.col("token").isin(words))

    def visible(self, rows: DataFrame) -> DataFrame:
        """Of rows(id, ...), those of documents that aren't hidden."""
        return rows if self.hidden is None else rows.join(self.hidden.select("id"), "id", "left_anti")


def _folder(token: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(folders)).cast("int")


#: The bytes of tokens in lower-cased text.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = True


def _tokens(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, tokens) of lower-cased texts: as T.tokens finds them, in order."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _INSIDE[text]
    edge = np.zeros(len(text) + 1, bool)  # where a text begins, so that tokens don't go on into the next
    edge[at] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    bound = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bound[1:])
    return np.searchsorted(at, start, "right") - 1, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bound), pa.py_buffer(text[inside]))


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value begins and the last ends) of numbers from 0: seven bits a byte, low ones first, the last byte below 128."""
    size = 1 + sum((values >= 1 << 7 * b).astype(np.int64) for b in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for b in range(int(size.max(initial=0))):
        some = size > b
        out[at[:-1][some] + b] = (values[some] >> 7 * b & 127) | (size[some] > b + 1) << 7
    return out, at


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128) + 1
    at = np.concatenate([[0], end[:-1]])
    out = np.zeros(len(end), np.int64)
    for b in range(int((end - at).max(initial=0))):
        some = end - at > b
        out[some] |= (raw[at[some] + b].astype(np.int64) & 127) << 7 * b
    return out


def _stems(names: pa.Array) -> pa.Array:
    """The stem of each token, null for function words. What ends in a digit is its own stem."""
    word = pc.match_substring_regex(names, "[a-z]$").to_numpy(zero_copy_only=False)
    by_rule = [None if t in T.ENGLISH_STOPWORDS else stem(t) for t in names.filter(pa.array(word)).to_pylist()]
    return pc.replace_with_mask(names, pa.array(word), pa.array(by_rule, names.type))


def _with_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["token"], _stems(b["token"])], ["token", "stem"])


def _block(weights: list[float]):
    """The rows (id, f0, f1, ...) of a block to its posting rows, by sorting all of its tokens once."""
    n_fields = len(weights)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["id"])).combine_chunks()
        number = table["block"][0].as_py()
        rows, kinds, found = [], [], []
        for k in range(n_fields):
            row, token = _tokens(table[f"f{k}"].combine_chunks())
            rows.append(row), kinds.append(np.full(len(row), k)), found.append(token)
        slot = np.concatenate(rows) * n_fields + np.concatenate(kinds)  # a field of a document
        coded = pa.concat_arrays(found).dictionary_encode()
        code, names = np.asarray(coded.indices, np.int64), coded.dictionary
        if n_fields > 1:
            by_doc = np.argsort(slot, kind="stable")  # tokens keep their order
            slot, code = slot[by_doc], code[by_doc]
        row = slot // n_fields
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = np.argsort(code, kind="stable")  # each token's places are in the order of ids and fields
        slot, code, place, row = slot[order], code[order], place[order], row[order]
        new = lambda *c: np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in c], axis=0)])) if len(row) else np.zeros(0, np.int64)
        of_field, of_doc, of_token = new(code, slot), new(code, row), new(code)
        steps = np.diff(place, prepend=0)
        steps[of_field] = place[of_field]
        data, at = _packed(steps)
        n = len(of_doc)
        counts = np.zeros((n, n_fields), np.int32)
        counts[np.searchsorted(of_doc, of_field, "right") - 1, slot[of_field] % n_fields] = np.diff(np.append(of_field, len(row)))
        score = np.zeros(n)
        for k in range(n_fields):
            score += counts[:, k] * weights[k]
        cuts = np.append(np.searchsorted(of_doc, of_token), n)
        ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), table["id"].combine_chunks().take(pa.array(row[of_doc])))
        lists = pa.ListArray.from_arrays(pa.array((cuts * n_fields).astype(np.int32)), pa.array(counts.ravel()))
        ends = at[np.append(of_token, len(row))]
        packed = pa.Array.from_buffers(pa.binary(), len(of_token), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        return pa.table({
            "token": names.take(pa.array(code[of_token])).cast(pa.string()), "block": pa.array(np.full(len(of_token), number, np.int32)),
            "most": pa.array(np.maximum.reduceat(score, cuts[:-1]) if n else score), "ids": ids, "counts": lists, "steps": packed,
        })

    return run


def _dealt(rows: DataFrame, blocks: int, *keys) -> DataFrame:
    """rows dealt by keys over a session's partitions, or over more, so that none has many more than TASK_BLOCKS blocks' worth."""
    wanted = blocks // TASK_BLOCKS
    return rows.repartition(wanted, *keys) if wanted > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def _weights(fields: dict[str, str]) -> tuple[float, ...]:
    return tuple(R.WEIGHTS[w] for w in fields)


def postings(docs: DataFrame, id: str, fields: dict[str, str], blocks: int, folders: int) -> DataFrame:
    """(folder, token, block, n_docs, n, most, ids, counts, steps) of docs; fields: weight letter -> column, as for a lexical stream."""
    low = (F.lower(F.col(c).cast("string")).alias(f"f{k}") for k, c in enumerate(fields.values()))
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int").alias("block"), *low)
    kind = dict(rows.dtypes)["id"]
    schema = f"token string, block int, most double, ids array<{kind}>, counts array<int>, steps binary"
    out = _dealt(rows, blocks, "block").groupBy("block").applyInArrow(_block(list(_weights(fields))), schema)
    dealt = _dealt(out, blocks, _folder(F.col("token"), folders), F.floor(F.col("block") / FILES))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    return dealt.select(_folder(F.col("token"), folders).alias("folder"), "token", "block", F.size("ids").alias("n_docs"), n.alias("n"), "most", "ids", "counts", "steps")


def _scored(weights: tuple[float, ...]) -> Column:
    """(id, score) of each document of a posting row: occurrences by the weights of their fields, added in the order of the fields."""

    def one(id: Column, k: Column) -> Column:
        total = F.lit(0.0)
        for f, w in enumerate(weights):
            total = total + F.get("counts", k * len(weights) + f).cast("long") * F.lit(w)
        return F.struct(id.alias("id"), total.alias("score"))

    return F.transform("ids", one)


def token_index(docs: DataFrame, id: str, fields: dict[str, str] | None = None, english: bool = False) -> TokenIndex:
    """The index of docs, built once for the files that docs reads. Counts them, and builds the index if it isn't there yet.
    english: the same index, searched by stems."""
    fields = fields or {"D": "text"}
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    folders = max(8, min(4096, blocks // 8))
    table = kept(docs, "tokens", lambda: postings(docs, id, fields, blocks, folders), by=("folder",), sort=("token", "block"), id=id, fields=fields, blocks=blocks, folders=folders, layout=LAYOUT)
    return TokenIndex(table, folders, blocks, _weights(fields), english)


def with_changes(index: TokenIndex, docs: DataFrame, id: str, fields: dict[str, str] | None = None, removed: DataFrame | None = None) -> TokenIndex:
    """index after docs were added or replaced and the ids of removed(id) deleted."""
    ids = docs.select(F.col(id).alias("id"))
    gone = ids.unionByName(removed.select("id")) if removed is not None else ids
    fields = fields or {"D": "text"}
    part = postings(docs, id, fields, index.blocks, index.folders)
    return _hide(index, gone.distinct(), TokenIndex(part, index.folders, index.blocks, _weights(fields), index.english))


def _hide(index: TokenIndex, ids: DataFrame, newer: TokenIndex) -> TokenIndex:
    hidden = ids if index.hidden is None else index.hidden.unionByName(ids).distinct()
    return replace(index, hidden=hidden, newer=_hide(index.newer, ids, newer) if index.newer else newer)


def lexicon(index: TokenIndex) -> DataFrame:
    """(token, n_docs, n) of every token: documents that hold it, and its occurrences."""
    every = None
    for part in index.parts():
        if part.hidden is None:
            rows = part.postings.select("token", F.col("n_docs").cast("long").alias("n_docs"), "n")
        else:
            k = len(part.weights)
            each = F.transform("ids", lambda id, i: F.struct(id.alias("id"), F.aggregate(F.slice("counts", i * k + 1, k), F.lit(0).cast("long"), lambda s, c: s + c).alias("n")))
            rows = part.visible(part.postings.select("token", F.inline(each))).select("token", F.lit(1).cast("long").alias("n_docs"), "n")
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("token").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def _no_rows(index: TokenIndex) -> DataFrame:
    kind = index.postings.schema["ids"].dataType.elementType
    return index.postings.sparkSession.createDataFrame([], StructType([StructField("id", kind), StructField("score", DoubleType())]))


def _single(part: TokenIndex, word: str, k: int | None) -> DataFrame:
    rows = part.rows([word])
    if k is not None and part.blocks > k and part.hidden is None:
        # The k-th highest block maximum is reached by k documents: blocks below it hold none of the k best.
        best = [r[0] for r in rows.select("most").orderBy(F.desc("most")).limit(k).collect()]
        rows = rows.where(F.col("most") >= best[-1] * (1 - 1e-12)) if len(best) == k else rows
    return part.visible(rows.select(F.inline(_scored(part.weights))))


def _any_form(part: TokenIndex, word: str) -> DataFrame:
    """(id, n0, n1, ...): the occurrences of all tokens of a stem in each field of the documents of a part that hold one."""
    k = len(part.weights)
    each = F.transform("ids", lambda id, i: F.struct(id.alias("id"), *(F.get("counts", i * k + f).cast("long").alias(f"n{f}") for f in range(k))))
    rows = part.visible(part.rows(list(part.forms([word]))).select(F.inline(each)))
    return rows.groupBy("id").agg(*(F.sum(f"n{f}").alias(f"n{f}") for f in range(k)))


def _merged(part: TokenIndex, words: list[str], value: str) -> DataFrame:
    """(id, score) of the documents of a part that hold all words; value: ``cover`` (density) or ``count`` (occurrences)."""
    forms = part.forms(words)
    passed = [w for w in T.ENGLISH_STOPWORDS if part.english and value == "cover"]  # they take no place
    rows = part.rows([*forms, *passed]).select("block", "token", "ids", "counts", "steps")
    kind = part.postings.schema["ids"].dataType.elementType
    place, weights = {t: words.index(w) for t, w in forms.items()}, part.weights

    def scored(table: pa.Table) -> pa.Table:
        """The rows of a block, one for each token that occurs in it."""
        name = table.schema.field("ids").type.value_type
        tokens = table["token"].to_pylist()
        lists = [r.as_py() for r in table["ids"]]
        holding = [set().union(*(x for x, t in zip(lists, tokens, strict=True) if place.get(t) == k)) for k in range(len(words))]
        common = sorted(set.intersection(*holding))
        where = [dict(zip(x, range(len(x)), strict=True)) for x in lists] if common else []
        ends = [np.concatenate([[0], np.cumsum(c.values.to_numpy())]) for c in table["counts"]] if common else []
        steps = [_unpacked(x.as_py()) for x in table["steps"]] if common else []
        score = []
        for i in common:
            found, less = [], [np.zeros(0, np.int64)]
            for r, token in enumerate(tokens):
                if i not in where[r]:
                    continue
                slot = where[r][i] * len(weights)
                for f, w in enumerate(weights):
                    at = np.cumsum(steps[r][ends[r][slot + f] : ends[r][slot + f + 1]])
                    if token in place:
                        found += [(int(p), place[token], w) for p in at]
                    else:
                        less.append(at)
            less = np.sort(np.concatenate(less))
            found = [(p - int(np.searchsorted(less, p)), k, w) for p, k, w in found] if len(less) else found
            score.append(float(len(found)) if value == "count" else R._cover_score(sorted(found), len(words)))
        return pa.table({"id": pa.array(common, name), "score": pa.array(score, pa.float64())})

    return part.visible(rows.groupBy("block").applyInArrow(scored, StructType([StructField("id", kind), StructField("score", DoubleType())])))


def search(index: TokenIndex, query: str, k: int | None) -> DataFrame:
    """(id, score) of the k best documents that hold every word of the query, as retrieval.lexical_stream (lexical_stream_english by stems) gives them."""
    words, out = index.words(query), None
    if not words:
        return _no_rows(index)
    for part in index.parts():
        if len(words) > 1:
            rows = _merged(part, words, "cover")
        elif part.english:
            score = sum((F.col(f"n{f}") * F.lit(w) for f, w in enumerate(part.weights)), F.lit(0.0))
            rows = _any_form(part, words[0]).select("id", score.alias("score"))
        else:
            rows = _single(part, words[0], k)
        out = rows if out is None else out.unionByName(rows)
    return R.top(out, k)


def holding(index: TokenIndex, query: str) -> DataFrame:
    """(id, n) of all documents that hold every word of the query, with the occurrences of these words."""
    words, out = index.words(query), None
    if not words:
        return _no_rows(index).select("id", F.col("score").cast("long").alias("n"))
    for part in index.parts():
        if part.english and len(words) == 1:
            rows = _any_form(part, words[0]).select("id", sum((F.col(f"n{f}") for f in range(len(part.weights))), F.lit(0).cast("long")).alias("n"))
        else:
            rows = _merged(part, words, "count").select("id", F.col("score").cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _with_part_of_word(index: TokenIndex, piece: str) -> DataFrame:
    """Distinct ids of the documents with a token that holds a piece."""
    out = None
    for part in index.parts():
        rows = part.visible(part.postings.where(F.col("token").contains(piece)).select(F.explode("ids").alias("id")))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def with_substring_fallback(index: TokenIndex, docs: DataFrame, query: str, k: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """As retrieval.with_substring_fallback. Every run of letters and digits in the query lies in a token of a text that holds
    the query, so the tokens say where to look; only a query with other characters reads the texts of the documents found so."""
    low, words = query.lower(), R.lexemes(query)
    if not words:
        return R.with_substring_fallback(docs, query, k, id, text)
    exact = holding(index, query).select("id", (F.col("n") * 0.1).alias("score"))
    loose = None
    for w in words:
        ids = _with_part_of_word(index, w)
        loose = ids if loose is None else loose.join(ids, "id", "left_semi")
    if re.fullmatch("[a-z0-9]+", low) is None:
        texts = docs.select(F.col(id).alias("id"), F.col(text).alias("searched"))
        loose = texts.join(loose, "id", "left_semi").where(F.lower("searched").contains(low)).select("id")
    loose = loose.join(exact.select("id"), "id", "left_anti").select("id", F.lit(R.FALLBACK_SCORE).alias("score"))
    return R.top(exact.unionByName(loose), k)
