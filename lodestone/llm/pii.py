"""Personal data: exact base patterns, extended by a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from the patterns of ``base_spans``. The field then
labels the text's tokens that hold a digit or ``@`` with O or one of the four kinds. Neighbouring
tokens share chain potentials; the occurrences of one key (the same word without its edge
punctuation, the same digits, or the same last seven digits) are joined, each to the next, by skip
potentials. For the labelling each is also joined to the key's first token in a base span of each kind, so that
evidence reaches all mentions in one step, however many lie between. Loopy sum-product message passing
runs over all texts of a batch at once, for each until its messages stop changing (by SETTLED or
less; ROUNDS only ends loops that never settle). Tokens in base spans are observed; other tokens become spans of a kind
if their belief in it is at least CONFIDENCE and they don't touch a base span.

Potentials are fitted by pseudo-likelihood (so each token is predicted from its own shape and its
neighbours' labels) on the base spans of at most MAX_TRAIN_ROWS documents, those of smallest hash. There
the shape, and the chain neighbours, are hidden for some tokens, so that skip potentials are
learned from agreement itself.

Everything is a map over texts; the model has a fixed size. Links are linear in the tokens.

Edge cases: null and empty texts have no spans (the digest is that of the empty string). A table
without training tokens leaves the base spans alone. Copies of a row get the same result. Offsets
are code points, ends exclusive. Extra columns are ignored by find and kept by redact.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import MAX_BYTES, bounded, one_text
from lodestone.llm.words import Words, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0 is O
#: Tokens of one kind in a row are one span up to so many digits; by label.
MOST_DIGITS = (0, 0, 0, 19, 15)
MAX_TRAIN_ROWS = 4000
HASHED = 1 << 12
CONFIDENCE = 0.9
ROUNDS, SETTLED, DAMPING = 1000, 1e-4, 0.3
STEPS, RATE, DECAY, HIDDEN = 300, 0.1, 0.2, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EDGE = re.compile(r"^[^0-9A-Za-z+]+|[^0-9A-Za-z]+$")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind (index into KINDS), end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, sorted."""
    out: list[Span] = []
    # Every email has one @, and its local part is the run of local characters before it: looking from
    # each @ gives the leftmost matches without trying every start.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z\x80-\U0010ffff]", "a", re.sub(r"[0-9]", "9", word)))[:24]


def _features(word: str) -> list[int]:
    """Hashed shape features of a token; the first three tell its validity."""
    core = _EDGE.sub("", word)
    digits = re.sub(r"[^0-9]", "", core)
    octets = core.split(".")
    told = (
        ("luhn", len(digits) >= 12 and luhn(digits)),
        ("octets", len(octets) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in octets)),
        ("domain", "@" in core and bool(_DOMAIN.match(core.rpartition("@")[2]))),
        ("digits", min(len(digits), 20)),
        ("letters", min(sum(c.isalpha() for c in core), 6)),
        ("shape", _shape(core)),
        ("plus", core[:1] == "+"),
        ("bias", 1),
    )
    return [zlib.crc32(f"{k}={v}".encode()) % HASHED for k, v in told]


N_FEATURES = 8


def _keys(word: str) -> list[str]:
    core = _EDGE.sub("", word).lower()
    digits = re.sub(r"[^0-9]", "", core)
    out = ["w" + core] if len(core) > 3 else []
    if len(digits) > 4 and "@" not in core:
        out += ["d" + digits] + (["t" + digits[-7:]] if len(digits) >= 7 else [])
    return out


@dataclass
class Tokens:
    """Tokens of several texts: arrays over tokens, and links between them."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feature: np.ndarray
    digits: np.ndarray  # how many
    label: np.ndarray  # by the base spans
    chain: np.ndarray  # pairs of token indices
    skip: np.ndarray
    told: np.ndarray  # links to base spans that skip lacks; not used for fitting


def tokens_of(texts: list[tuple[int, str, list[Span]]]) -> Tokens:
    """texts: (row, text, base spans)."""
    row, start, end, digits, feature, label, chain, skip, told = [], [], [], [], [], [], [], [], []
    for r, text, spans in texts:
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        held: dict[str, list[int]] = {}
        before = -2
        kinds: dict[int, int] = {}  # by word; the first span that touches it counts
        ends = [b for _, b in words]
        for a, kind, b in spans:
            k = bisect_right(ends, a)
            while k < len(words) and words[k][0] < b:
                kinds.setdefault(k, kind + 1)
                k += 1
        for k, (a, b) in enumerate(words):
            word = text[a:b]
            if "@" not in word and not any(c in "0123456789" for c in word):
                continue
            here = len(row)
            row.append(r)
            core = _EDGE.sub("", word)
            lead = word.find(core) if core else 0
            start.append(a + lead)
            end.append(a + lead + len(core) if core else b)
            digits.append(sum(c in "0123456789" for c in core))
            label.append(kinds.get(k, 0))
            feature.append(_features(word))
            if before == k - 1:
                chain.append((here - 1, here))
            before = k
            for key in _keys(word):
                if key in held:
                    skip.append((held[key][-1], here))
                held.setdefault(key, []).append(here)
        for at in held.values():
            first: dict[int, int] = {}
            for k in at if len(at) > 2 else ():
                if label[k]:
                    first.setdefault(label[k], k)
            told += [(min(k, f), max(k, f)) for f in first.values() for k in at if not label[k]]
    pair = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
    told = set(told).difference(skip)
    return Tokens(*(np.array(x, np.int64) for x in (row, start, end)), np.array(feature, np.int64).reshape(-1, N_FEATURES), np.array(digits, np.int64), np.array(label, np.int64), pair(chain), pair(skip), pair(told))


@dataclass
class Field:
    own: np.ndarray  # HASHED x LABELS
    chain: np.ndarray  # LABELS x LABELS, symmetric
    skip: np.ndarray

    def beliefs(self, t: Tokens) -> np.ndarray:
        """Marginals by loopy sum-product; tokens of a base span are clamped to its kind."""
        n = len(t.row)
        own = self.own[t.feature].sum(axis=1)
        seen = t.label > 0
        own[seen] = np.where(np.arange(LABELS) == t.label[seen, None], 0.0, -50.0)
        edge = np.concatenate([t.chain, t.skip, t.told])
        if len(edge):
            potential = np.concatenate([np.repeat(self.chain[None], len(t.chain), 0), np.repeat(self.skip[None], len(t.skip) + len(t.told), 0)])
            source, target = np.concatenate([edge[:, 0], edge[:, 1]]), np.concatenate([edge[:, 1], edge[:, 0]])
            potential = np.concatenate([potential, potential])
            back = np.concatenate([np.arange(len(edge)) + len(edge), np.arange(len(edge))])
            message = np.zeros((len(source), LABELS))
            live = np.arange(len(source))  # the links of texts that have not settled
            for _ in range(ROUNDS):
                before = message[live]
                total = own.copy()
                np.add.at(total, target[live], before)
                at = (total[source[live]] - message[back[live]])[:, :, None] + potential[live]
                new = np.logaddexp.reduce(at, axis=1)
                new -= np.logaddexp.reduce(new, axis=1)[:, None]
                message[live] = DAMPING * before + (1 - DAMPING) * new
                rows = t.row[source[live]]
                live = live[np.isin(rows, rows[np.abs(message[live] - before).max(axis=1) > SETTLED])]
                if not len(live):
                    break
            own = own.copy()
            np.add.at(own, target, message)
        return np.exp(own - np.logaddexp.reduce(own, axis=1)[:, None]) if n else own

    def spans(self, t: Tokens) -> dict[int, list[Span]]:
        """Added spans by row: adjacent tokens of one confident kind, as far as their digits fit."""
        out: dict[int, list[Span]] = {}
        if not len(t.row):
            return out
        p = self.beliefs(t)
        kind = np.where((p.max(axis=1) >= CONFIDENCE) & (t.label == 0), p.argmax(axis=1), 0)
        held = 0
        joined = set(map(tuple, t.chain.tolist()))
        for k in np.flatnonzero(kind).tolist():
            rows = out.setdefault(int(t.row[k]), [])
            held = held + int(t.digits[k]) if rows and (k - 1, k) in joined and kind[k - 1] == kind[k] else MOST_DIGITS[kind[k]] + 1
            if held <= MOST_DIGITS[kind[k]]:
                rows[-1] = (rows[-1][0], rows[-1][1], int(t.end[k]))
            else:
                held = int(t.digits[k])
                rows.append((int(t.start[k]), int(kind[k]) - 1, int(t.end[k])))
        return out


def fit_field(t: Tokens, seed: int = 3) -> Field:
    """Pseudo-likelihood by Adam. Some tokens' shapes are hidden in each step."""
    n = len(t.row)
    own, chain, skip = np.zeros((HASHED, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if not n or not t.label.any():
        own[:, 0] = 1.0
        return Field(own, chain, skip)
    counts = []
    for edges in (t.chain, t.skip):
        c = np.zeros((n, LABELS))
        np.add.at(c, edges[:, 0], np.eye(LABELS)[t.label[edges[:, 1]]])
        np.add.at(c, edges[:, 1], np.eye(LABELS)[t.label[edges[:, 0]]])
        counts.append(c)
    used, where = np.unique(t.feature, return_inverse=True)
    where = where.reshape(t.feature.shape)
    bias = N_FEATURES - 1
    small = np.zeros((len(used), LABELS))
    params = [small, chain, skip]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    draw, truth = np.random.default_rng(seed), np.eye(LABELS)[t.label]
    for step in range(1, STEPS + 1):
        shown = (draw.random((n, 1)) >= HIDDEN).astype(float) * np.ones((1, N_FEATURES))
        shown[:, bias] = 1
        near = counts[0] * (draw.random((n, 1)) >= HIDDEN)
        logit = (small[where] * shown[:, :, None]).sum(axis=1) + near @ chain + counts[1] @ skip
        p = np.exp(logit - np.logaddexp.reduce(logit, axis=1)[:, None])
        g = (p - truth) / n
        grads = [np.zeros_like(small), near.T @ g, counts[1].T @ g]
        for f in range(N_FEATURES):
            np.add.at(grads[0], where[:, f], g * shown[:, f : f + 1])
        for k in (1, 2):
            grads[k] = (grads[k] + grads[k].T) / 2
        for k, x in enumerate(params):
            grad = grads[k] + DECAY * x / n
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
            x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    own[used] = small
    return Field(own, chain, skip)


_MARKED = np.zeros(256, np.int64)
_MARKED[48:58] = _MARKED[64] = 1


def _with_candidates(words: Words) -> np.ndarray:
    """Which texts hold a digit or @; no other can have a span."""
    return words.sums(_MARKED[words.data]) > 0


def fit(documents: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_BYTES) -> Field:
    """A field fitted on the base spans of at most max_rows documents that have candidates, as far as
    their tokens fit into max_bytes; of a doc_id with several texts one is learnt from."""
    drawn = documents.where(F.col("text").rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in slices(batches):
            text = part.column("text").to_pylist()
            t = [tokens_of([(0, x, base_spans(x))]) for x in text]
            arrays = [pa.array([np.ascontiguousarray(getattr(x, f)).astype(np.int32).tobytes() for x in t], pa.binary()) for f in ("feature", "label", "chain", "skip")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "feature", "label", "chain", "skip"])

    rows = one_text(documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))
    found = rows.mapInArrow(extract, "doc_id long, feature binary, label binary, chain binary, skip binary")
    size = sum((F.octet_length(x) for x in ("feature", "label", "chain", "skip")), F.lit(0))
    got = bounded(found, size, max_bytes).toArrow().sort_by("doc_id").to_pydict()
    parts, ahead = {"feature": [], "label": [], "chain": [], "skip": []}, 0
    for k in range(len(got["doc_id"])):
        read = {f: np.frombuffer(got[f][k], np.int32).astype(np.int64) for f in parts}
        parts["feature"].append(read["feature"].reshape(-1, N_FEATURES))
        parts["label"].append(read["label"])
        for f in ("chain", "skip"):
            parts[f].append(read[f].reshape(-1, 2) + ahead)
        ahead += len(read["label"])
    whole = {f: np.concatenate(x) if x else np.zeros((0, N_FEATURES if f == "feature" else 2), np.int64) for f, x in parts.items()}
    label = whole["label"].reshape(-1)
    blank = np.zeros(len(label), np.int64)
    return fit_field(Tokens(blank, blank, blank, whole["feature"], blank, label, whole["chain"], whole["skip"], np.zeros((0, 2), np.int64)))


def _found(part: pa.RecordBatch, words: Words, field: Field) -> dict[int, tuple[str, list[Span], list[Span]]]:
    """(text, base spans, all spans) of the rows that have candidates."""
    rows = np.flatnonzero(_with_candidates(words)).tolist()
    column = part.column("text")
    texts = [(r, x, base_spans(x)) for r in rows for x in (column[r].as_py(),)]
    more = field.spans(tokens_of(texts))
    return {r: (x, base, sorted(base + more.get(r, []))) for r, x, base in texts}


_EMPTY = hashlib.sha256(b"").hexdigest()


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of documents.

    The counts and the digest are of the base spans, ``spans`` lists all.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches):
            n = np.zeros((len(KINDS), part.num_rows), np.int64)
            digest, spans = [_EMPTY] * part.num_rows, [""] * part.num_rows
            for r, (_, base, every) in _found(part, words, shared.value).items():
                for _, k, _ in base:
                    n[k, r] += 1
                digest[r], spans[r] = hashlib.sha256(told(base).encode()).hexdigest(), told(every)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, n), pa.array(digest), pa.array(spans)], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return documents.select("doc_id", "text").mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first, as ``[EMAIL]``."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """documents with their spans masked in ``text``; ``n_chars``, if there, follows."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches):
            found = _found(part, words, shared.value)
            text = part.column("text").to_pylist()
            for r, (x, _, spans) in found.items():
                text[r] = masked(x, spans)
            columns = {x: part.column(x) for x in part.schema.names} | {"text": pa.array(text, part.schema.field("text").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = documents.mapInArrow(rewritten, documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
