"""Quality classifier: hashed word n-gram logistic regression with FTRL updates.

Features: words as they are split by whitespace (lower-cased in A-Z), their last three bytes,
their shape (case, symbols, length class), pairs of neighbouring words and of neighbouring
shapes, and whether a word repeats the one before it. Scores are sparse dot products with a
model of fixed size.

Null and empty texts have no features and get the score of the bias. Copies get equal scores.
Null labels and labels without a document don't train; without training rows scores are 0.5.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import linear
from lodestone.llm.words import SPACED, Words

BITS = 20
MAX_TRAIN_ROWS = 8000  # the bounded sample that the classifier is fitted on
THRESHOLD = 0.3
FIT = {"alpha": 0.3, "beta": 1.0, "l1": 1.0, "l2": 0.0, "epochs": 3}

_UPPER, _SYMBOL = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = 1


def _in_words(words: Words, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(table[words.data], out=total[1:])
    return total[words.end] - total[words.start]


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    row, h = words.row, words.hashes()
    length = words.end - words.start
    upper, symbol = _in_words(words, _UPPER), _in_words(words, _SYMBOL)
    shape = np.minimum(upper, 3) * 64 + np.minimum(symbol, 3) * 16 + np.minimum(length // 3, 15)
    shape = (shape + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tail = words.span_hashes(np.maximum(words.start, words.end - 3), words.end, True)
    same = row[:-1] == row[1:]
    again = np.flatnonzero(same & (h[:-1] == h[1:]))
    return [
        (row, h),
        (row, tail),
        (row, shape),
        (row[:-1][same], (h[:-1] * np.uint64(31) + h[1:])[same]),
        (row[:-1][same], (shape[:-1] * np.uint64(31) + shape[1:])[same]),
        (row[again], np.ones(len(again), np.uint64)),
    ]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> linear.Model:
    """Learn from at most max_rows rows of labels(doc_id, quality) outside the held-out fifth."""
    rows = linear.sample(documents, labels.where(~held_out()), "quality", features, BITS, max_rows, SPACED)
    return linear.train(rows, BITS, **FIT)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = linear.score(documents, fit(documents, labels), features, SPACED)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
