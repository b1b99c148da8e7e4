"""Toxicity: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased in A-Z. Features: the word, the word cut to
its first three, four and five bytes (a truncation stem, so that unseen inflections share
weights), the pair of neighbours, and the pair that skips one word. Per-coordinate rates and
L1 leave a few ten thousand weights of 2**20, so the broadcast model is small and fixed in size.

Null and empty texts have no features and get the score of the bias. Copies of a text get the
same score. Labels that are null, or whose document is missing, don't train; without any
training row every score is 0.5. Extra columns are ignored by judge and kept by drop_toxic, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import linear
from lodestone.llm.shared import free_names
from lodestone.llm.words import ALNUM, Words

BITS = 20
MAX_TRAIN_ROWS = 8000  # the bounded sample that the classifier is fitted on
THRESHOLD = 0.7
STEMS = (3, 4, 5)
FIT = {"alpha": 0.5, "beta": 1.0, "l1": 1.0, "l2": 0.0, "epochs": 3}


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    row, h = words.row, words.hashes()
    out = [(row, h)] + [(row, words.span_hashes(words.start, np.minimum(words.end, words.start + k), True)) for k in STEMS]
    for gap in (1, 2):
        same = row[:-gap] == row[gap:]
        out.append((row[:-gap][same], (h[:-gap] * np.uint64(31) + h[gap:])[same]))
    return out


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> linear.Model:
    """Learn from at most max_rows rows of labels(doc_id, toxic) outside the held-out third."""
    rows = linear.sample(documents, labels.where(~held_out()), "toxic", features, BITS, max_rows, ALNUM)
    return linear.train(rows, BITS, **FIT)


def score(documents: DataFrame, model: linear.Model) -> DataFrame:
    """(doc_id, score) of every document."""
    return linear.score(documents, model, features, ALNUM)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    model = fit(documents, labels)
    (name,) = free_names(documents.columns, "toxicity")
    return linear.append_score(documents, model, features, ALNUM, name).where(F.col(name) < THRESHOLD).drop(name)
