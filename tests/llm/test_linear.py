import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import linear, quality, toxicity
from lodestone.llm.words import ALNUM

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900):
    """Every third text holds one of a few bad words; every fifth is full of symbols."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(draw.randint(5, 60))]
        if toxic := k % 3 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(["vilescum", "vilescums", "grotrat"]))
        if bad := k % 5 == 0:
            words = [w + "###" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("module", "column", "mod", "hold", "threshold"), [(toxicity, 2, 3, 1, 0.7), (quality, 1, 5, 0, 0.3)])
def test_held_out_accuracy_and_fold(spark, documents, module, column, mod, hold, threshold):
    rows, labels = corpus()
    got = module.judge(documents(rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    right = 0
    held = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == hold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    for r in held:
        right += r["predicted"] == labels[r["doc_id"]][column]
    assert right / len(held) > 0.95


def test_edge_rows_copies_and_no_labels(spark, documents):
    rows, labels = corpus(300)
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "vilescum " * 20000), (1004, "abcd"), (1004, "abcd"), (None, "abcd")]
    for module in (toxicity, quality):
        got = module.judge(documents(rows + odd), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (7777, 1, 1)], LABELS)).collect()
        score = {}
        for r in got:
            score.setdefault(r["doc_id"], set()).add(r["score"])
        assert len(got) == len(rows) + len(odd)
        assert score[1000] == score[1001] == score[1002] and len(score[1004]) == 1 and score[None] == score[1004]
        none = module.judge(documents(odd), spark.createDataFrame([], LABELS)).collect()
        assert {r["score"] for r in none} == {0.5}
        assert module.judge(documents([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_drop_toxic_keeps_columns(spark, documents):
    rows, labels = corpus(600)
    docs = documents(rows, extra=True)
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(k % 3 == 0 for k in ids) < 20 and sum(k % 3 > 0 for k in ids) > 390


def test_weights_are_sparse(spark, documents):
    rows, labels = corpus(300)
    model = toxicity.fit(documents(rows), spark.createDataFrame(labels, LABELS))
    assert 0 < len(model.bucket) < 2000


def test_updates_match_a_plain_loop():
    """FTRL-proximal written out for one coordinate at a time, in the same order of rows."""
    draw = np.random.default_rng(2)
    rows = [(int(draw.integers(0, 2)), np.unique(draw.integers(0, 16, 5)).astype(np.int32), None) for _ in range(60)]
    rows = [(y, b, draw.integers(1, 4, len(b))) for y, b, _ in rows]
    alpha, beta, l1, l2, epochs, seed = 0.2, 1.0, 0.3, 0.1, 2, 7
    z, n = {}, {}

    def weight(i):
        own = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= own:
            return 0.0
        return -(z[i] - math.copysign(own, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, bucket, count = rows[r]
            x = {int(b): math.log1p(c) for b, c in zip(bucket, count)} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, before = (p - y) * v, n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / alpha * w[i]
    model = linear.train(rows, 4, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs, seed=seed)
    full = model.dense()
    assert [pytest.approx(weight(i), abs=1e-12) for i in range(16)] == full.tolist() and model.bias == pytest.approx(weight("bias"))
    assert 0 < len(model.bucket) < 16


def test_sample_is_bounded_in_rows_and_bytes(spark, documents):
    rows, labels = corpus(60)
    labels = spark.createDataFrame(labels, LABELS)
    once = documents(rows)
    often = once.union(once.where("doc_id = 3").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("k"), "text", "lang", "source", "n_chars").drop("k"))
    draw = lambda docs, **k: linear.sample(docs, labels, "toxic", toxicity.features, toxicity.BITS, 50, ALNUM, **k)
    few, same = draw(once), draw(often)
    assert len(few) == len(same) == 50 and all((a[1] == b[1]).all() and a[0] == b[0] for a, b in zip(few, same))
    size = sum(b.nbytes + c.nbytes for _, b, c in few)
    part = draw(once, max_bytes=size // 2)
    assert 0 < len(part) < 50 and sum(b.nbytes + c.nbytes for _, b, c in part) <= size // 2


def test_a_null_id_is_not_held_out(spark, documents):
    rows, labels = corpus(30)
    for module in (toxicity, quality):
        got = module.judge(documents(rows + [(None, "abcd")]), spark.createDataFrame(labels, LABELS)).where("doc_id is null").collect()
        assert [r["held_out"] for r in got] == [False]


def test_scores_are_plain_sums_of_the_features_weights(documents):
    """Words, cut words, pairs and skipped pairs counted in plain Python, with a model of random weights."""
    import re

    import pyarrow as pa

    from lodestone.llm.words import Words

    full = 2**64 - 1

    def whole(piece: bytes) -> int:
        """The hash of bytes, as of a range of some text."""
        words = Words(pa.array(["x" * len(piece)]))
        words.data = np.frombuffer(piece, np.uint8)
        return int(words.span_hashes(np.array([0]), np.array([len(piece)]), True)[0])

    def mixed(h: int) -> int:
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    draw = np.random.default_rng(8)
    bits = toxicity.BITS
    bucket = np.sort(draw.choice(1 << bits, 1 << 18, replace=False)).astype(np.int32)
    model = linear.Model(bucket, draw.normal(0, 1, len(bucket)), -0.25, bits)
    dense = model.dense()
    texts = ["Vile words, VILE words; and vile-words again", "äöü straße äöü", "", None, "one", "a b a b a b a b", "x" * 300 + " y"]
    for r in toxicity.score(documents(texts), model).collect():
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (texts[r["doc_id"]] or "").encode())
        words = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words]
        h = [whole(w) for w in words]
        kinds = [h, *([whole(w[:k]) for w in words] for k in toxicity.STEMS)] + [[(a * 31 + b) & full for a, b in zip(h, h[gap:])] for gap in (1, 2)]
        counts = {}
        for kind, values in enumerate(kinds):
            for v in values:
                b = mixed((v + kind) & full) >> 64 - bits
                counts[b] = counts.get(b, 0) + 1
        total = sum(dense[b] * math.log1p(n) for b, n in counts.items()) + model.bias
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_quality_counts_are_plain_counts(documents):
    """Words, their ends, shapes, pairs and repeats of a quality model of random weights, in plain Python."""
    import re

    import pyarrow as pa

    from lodestone.llm.words import Words

    full = 2**64 - 1

    def whole(piece: bytes) -> int:
        words = Words(pa.array(["x" * len(piece)]))
        words.data = np.frombuffer(piece, np.uint8)
        return int(words.span_hashes(np.array([0]), np.array([len(piece)]), True)[0])

    def mixed(h: int) -> int:
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    draw = np.random.default_rng(9)
    bits = quality.BITS
    bucket = np.sort(draw.choice(1 << bits, 1 << 18, replace=False)).astype(np.int32)
    model = linear.Model(bucket, draw.normal(0, 1, len(bucket)), 0.5, bits)
    dense = model.dense()
    texts = ["Good GOOD good, #tags## and: (more)", "é é É\tx\u000by", "", None, "ab " * 5]
    scored = linear.score(documents(texts), model, quality.features)
    for r in scored.collect():
        words = re.findall(rb"[^\x20\x09-\x0d]+", (texts[r["doc_id"]] or "").encode())
        low = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words]
        h = [whole(w) for w in low]
        upper = [sum(65 <= c <= 90 for c in w) for w in words]
        symbol = [sum(33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in w) for w in words]
        shape = [(min(u, 3) * 64 + min(s, 3) * 16 + min(len(w) // 3, 15) + 1) * 0x9E3779B97F4A7C15 & full for u, s, w in zip(upper, symbol, words)]
        pairs = lambda x: [(a * 31 + b) & full for a, b in zip(x, x[1:])]
        kinds = [h, [whole(w[-3:]) for w in low], shape, pairs(h), pairs(shape), [1] * sum(a == b for a, b in zip(h, h[1:]))]
        counts = {}
        for kind, values in enumerate(kinds):
            for v in values:
                b = mixed((v + kind) & full) >> 64 - bits
                counts[b] = counts.get(b, 0) + 1
        total = sum(dense[b] * math.log1p(n) for b, n in counts.items()) + model.bias
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
