"""Quality rules: exact text statistics, and a decision list learned from labelled ones.

Statistics are counted over whole texts (see ``statistics``). Sequential covering then learns
rules for bad documents: a rule is grown by adding the threshold condition of most gain (FOIL)
on two thirds of the remaining labelled rows, pruned on the last third by dropping final
conditions while its precision there doesn't fall, and kept if it is precise enough; the rows it
covers are taken out and the next rule is grown. The list is emitted as one ordered Spark
conditional expression, so that it reads and runs like hand-written rules.

Learning reads at most MAX_TRAIN_ROWS labelled rows (those of smallest hash of doc_id).

Edge cases: null, empty or wordless texts have zero statistics and fail the base rule. Without
labels, or without bad ones, the list is empty and keeps what passes the base rule. Ties between
conditions go to the first statistic, then the smaller threshold. Repeated rows are each judged.
Extra columns are ignored by judge and kept by the statistics' ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import Words, mix, slices

MAX_TRAIN_ROWS = 20_000
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
#: What conditions may test: a name and its value from the counts.
RATIOS = {
    "words": "double(n_words)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}

_SYMBOL, _UPPER = np.zeros(256, np.int64), np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1


def _marks(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each (row, hash): does it occur twice or more?"""
    key = mix(h ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[back] > 1


def count_words(words: Words) -> dict[str, np.ndarray]:
    """The counts of COUNTS, for each text."""
    n = len(words.at) - 1
    row, h = words.row, words.hashes(fold=False)
    at, window = words.windows(h, WINDOW)
    twice = at[_marks(row[at], window)]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    repeated = np.cumsum(edge)[:-1] > 0

    # Lines: between line feeds and the ends of texts.
    feed = np.flatnonzero(words.data == 10)
    start = np.concatenate([words.at[:-1], feed + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(words.at[1:], feed, "right")])
    following = np.append(feed, len(words.data))
    end = np.minimum(following[np.searchsorted(following, start)], words.at[owner + 1]) if n else start
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, owner = start[has], end[has], owner[has]
    line = mix(words.span_hashes(start, end, fold=False) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    first = np.unique(line, return_index=True)[1]
    lines, distinct = np.bincount(owner, minlength=n), np.bincount(owner[first], minlength=n)

    letter = words.solid & ((words.data & 0xC0) != 0x80)
    return {
        "n_words": words.counts,
        "word_chars": words.sums(letter),
        "n_symbols": words.sums(_SYMBOL[words.data]),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": np.bincount(row[repeated], minlength=n),
        "n_upper": words.sums(_UPPER[words.data]),
        "n_lines": lines,
    }


def statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, and

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``;
    n_dup_lines: lines with a word that equal an earlier line of their text; n_repeat_words:
    words in windows of five found twice or more in the text; n_upper: A-Z; n_lines: lines with
    a word.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches):
            counts = count_words(words)
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keep), *(pa.array(counts[x].astype(np.int64)) for x in COUNTS)], [*keep, *COUNTS])

    schema = documents.select(*keep).schema
    for x in COUNTS:
        schema = schema.add(x, "long")
    return documents.select(*keep, "text").mapInArrow(counted, schema)


@dataclass
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(RATIOS).index(self.name)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = list[Condition]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most FOIL gain on rows x, of which some are bad."""
    base, best = np.log2(bad.mean()), (1e-9, None)
    for k, name in enumerate(RATIOS):
        order = np.argsort(x[:, k], kind="stable")
        value, hit = x[order, k], np.cumsum(bad[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        for above in (False, True):
            p = hit[-1] - hit[cut] if above else hit[cut]
            n = len(value) - 1 - cut if above else cut + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), 0.0)
            if len(gain) and gain.max() > best[0]:
                at = cut[gain.argmax()]
                best = float(gain.max()), Condition(name, above, float((value[at] + value[at + 1]) / 2))
    return best


def learn(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.9, least: int = 8, most_conditions: int = 4, most_rules: int = 20, seed: int = 5) -> list[Rule]:
    """An ordered list of rules for bad rows; x has a column for each of RATIOS.

    A rule is kept if at least ``precision`` of the rows that it covers are bad and at least
    ``least`` are.
    """
    rules: list[Rule] = []
    rest = np.arange(len(x))
    draw = np.random.default_rng(seed)
    while len(rules) < most_rules and bad[rest].sum() >= least:
        rows = draw.permutation(rest)
        grow, prune = rows[len(rows) // 3 :], rows[: len(rows) // 3]
        rule: Rule = []
        left = grow
        while len(rule) < most_conditions and bad[left].any() and not bad[left].all():
            _, condition = _best(x[left], bad[left])
            if condition is None:
                break
            rule.append(condition)
            left = left[condition.holds(x[left])]

        def quality(r: Rule, rows: np.ndarray = prune) -> float:
            hit = _covers(r, x[rows])
            return (bad[rows][hit].sum() + 1) / (hit.sum() + 2)

        while len(rule) > 1 and quality(rule[:-1]) >= quality(rule):
            rule = rule[:-1]
        hit = _covers(rule, x[rest]) if rule else np.zeros(len(rest), bool)
        if bad[rest][hit].sum() < least or bad[rest][hit].mean() < precision:
            break
        rules.append(rule)
        rest = rest[~hit]
    return rules


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> list[Rule]:
    """Learn from at most max_rows of labels(doc_id, quality); 0 is bad."""
    drawn = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    counted = statistics(documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), ("doc_id", "quality"))
    rows = counted.select("doc_id", "quality", *(F.expr(v).alias(k) for k, v in RATIOS.items()))
    # A doc_id with several texts is one row; the groups combine before the shuffle.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *RATIOS)).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return []
    x = np.stack([rows[k].to_numpy() for k in RATIOS], axis=1)
    return learn(x, rows["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1, else 0, as one conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, rule, kept) of each row of documents."""
    rules = fit(documents, labels)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = statistics(documents).select("*", base.alias("base_failed"), verdict(rules).alias("rule"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
