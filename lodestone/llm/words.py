"""Words of a batch of texts as numpy arrays over the batch's own UTF-8 bytes.

A word is a maximal run of bytes other than space and U+0009 to U+000D. All of these are
ASCII, so bytes and code points give the same words. Work runs in slices of about
``SLICE_BYTES`` of text, so memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The bytes of words between whitespace.
SPACED = ~_SPACE
#: Letters, digits and everything beyond ASCII: words without their punctuation.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z read as a-z
#: Masks of the first k bytes of a little-endian 64-bit value.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Ranges of more bytes are hashed one by one; a text has few of them.
LONG_BYTES = 4096
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can serve as a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several texts: ``start``/``end`` are byte positions, ``first[i]`` is the
    index of text i's first word (with one entry more than there are texts)."""

    def __init__(self, column: pa.Array, inside: np.ndarray = SPACED):
        """column: strings; null counts as the empty text. inside: which bytes words have."""
        if column.null_count:
            column = column.fill_null("")
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        solid = inside[self.data]
        begin, finish = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        finish[:-1] &= ~solid[1:]
        inner = self.at[(self.at > 0) & (self.at < len(solid))]
        begin[inner] = solid[inner]
        finish[inner - 1] = solid[inner - 1]
        self.solid = solid
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes anywhere.

        Each step takes eight bytes of all ranges that have so many left and mixes them in, so no
        pattern inside a range cancels out, as it does in sums of powers.
        """
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _FOLD[self.data] if fold else self.data
        eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
        length = (end - start).astype(np.int64)
        h = mix(length.astype(np.uint64) + np.uint64(_BASE))
        for k in np.flatnonzero(length > LONG_BYTES).tolist():
            digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest()
            h[k] ^= np.frombuffer(digest, np.uint64)[0]
        live = np.flatnonzero((length > 0) & (length <= LONG_BYTES))
        at, left = start[live].astype(np.int64), length[live]
        while len(live):
            h[live] = mix((h[live] ^ (eight[at] & _FIRST[np.minimum(left, 8)])) * np.uint64(_BASE))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h

    def hashes(self, fold: bool = True) -> np.ndarray:
        return self.span_hashes(self.start, self.end, fold)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value given for every byte."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return np.diff(total[self.at])

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words inside one text."""
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        m = len(hashes) - n + 1
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
        last = np.repeat(self.first[1:], self.counts)  # word index after each word's text
        keep = np.arange(m) + n <= last[:m]
        return np.flatnonzero(keep), mix(h[keep])


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each text's distinct n-word shingles, words lower-cased in A-Z.

    A text of fewer words than n has its whole sequence as one shingle; one without words
    has none. Sorted by text, then hash.
    """
    hashes, row, counts = words.hashes(), words.row, words.counts
    at, h = words.windows(hashes, n)
    rows = row[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            word = hashes[np.minimum(words.first[short] + k, len(hashes) - 1)]
            whole = np.where(has, whole * np.uint64(0xD6E8FEB86659FD93) + word, whole)
        rows, h = np.concatenate([rows, short]), np.concatenate([h, mix(whole + counts[short].astype(np.uint64))])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[keep], h[keep]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", inside: np.ndarray = SPACED) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Cut record batches into runs of rows of about SLICE_BYTES of text each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
        total, low = np.cumsum(sizes), 0
        while low < batch.num_rows:
            done = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, done + SLICE_BYTES, "right")))
            part = batch.slice(low, high - low)
            yield part, Words(part.column(part.schema.get_field_index(text)), inside)
            low = high


def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Values in row order as one list per row."""
    at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))
