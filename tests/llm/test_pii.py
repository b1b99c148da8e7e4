import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lodestone.llm import pii


def luhn(s):
    total = 0
    for k, c in enumerate(s[::-1]):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    draw = random.Random(7)
    for _ in range(20000):
        text = "".join(draw.choice("a@.-+0123 (é1%") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


def corpus():
    """Phone numbers with and without their prefix, mails, addresses and plain numbers."""
    draw = random.Random(8)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(5))
    rows = []
    for k in range(300):
        phone = f"+49 {digits(3)} {digits(7)}"
        parts = [word(), digits(draw.choice([1, 2, 3, 4, 7])), word(), phone if k % 2 else word(), word(), f"{word()}@{word()}.org" if k % 3 else digits(5), word(), f"{draw.randint(1, 255)}.{draw.randint(1, 255)}.3.4", word()]
        parts += [phone, word()] if k % 2 else []
        rows.append((k, " ".join(parts)))
    return rows


def test_field_agrees_on_repeated_tokens(documents):
    rows = corpus() + [(1000, "call +49 170 7654321 now, that is 7654321 again; room 1234567 is another"), (1001, None), (1002, ""), (1003, "no data here"), (1003, "no data here"), (1004, "x " * 30000 + "a@b.cd")]
    got = pii.find(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        base = brute(text[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.told(base).encode()).hexdigest()
        assert set(filter(None, pii.told(base).split(","))) <= set(r["spans"].split(","))
    found = {r["doc_id"]: r["spans"] for r in got}
    at = rows[300][1].rindex("7654321")
    assert f"phone:{at}:{at + 7}" in found[1000].split(",") and str(rows[300][1].index("1234567")) not in found[1000]
    assert found[1001] == found[1002] == found[1003] == ""


def test_without_training_tokens_and_empty_table(documents):
    assert pii.find(documents([])).count() == 0
    assert pii.find(documents([(1, "plain words"), (2, "7 of 9")])).where("spans != ''").count() == 0


def test_redact(documents):
    docs = documents(corpus() + [(2000, "Mail a.b@c.de or 10.0.0.1!"), (2001, None)], extra=True)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[2000] == ("Mail [EMAIL] or [IP]!", 21) and got[2001] == (None, None)
    assert not any(brute(t or "") for t, _ in got.values())


def test_overlapping_spans_mask_once():
    text = "+1 234567890@a.bc x"
    spans = pii.base_spans(text)
    assert pii.masked(text, spans).count("[") < len(spans) and pii.masked(text, spans).endswith(" x")


def test_evidence_reaches_every_mention(documents):
    bare = " and then 7654321 again" * 50
    rows = [(2000, f"call +49 170 7654321 now{bare}"), (2001, f"so{bare} call +49 170 7654321 now"), (2002, f"so{bare}")]
    found = {r["doc_id"]: set(r["spans"].split(",")) for r in pii.find(documents(corpus() + rows)).collect()}
    for doc, text in rows[:2]:
        missed = [m.start() for m in re.finditer("then 7654321", text) if f"phone:{m.start() + 5}:{m.end()}" not in found[doc]]
        assert not missed, (doc, missed)
    assert found[2002] == {""}


def test_a_text_is_labelled_the_same_alone_and_in_a_batch():
    texts = [t for _, t in corpus()[:40]] + ["call +49 170 7654321 now" + " and 7654321" * 30]
    tokens = lambda x: pii.tokens_of([(k, t, pii.base_spans(t)) for k, t in enumerate(x)])
    field = pii.fit_field(tokens(texts))
    assert field.spans(tokens(texts)).get(40) == field.spans(tokens(texts[40:])).get(0)


def enumerated(field, t):
    """Exact marginals: every labelling of the tokens, weighed by its potentials."""
    n = len(t.row)
    own = field.own[t.feature].sum(axis=1)
    out = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        if any(t.label[k] and labels[k] != t.label[k] for k in range(n)):
            continue
        score = sum(own[k, labels[k]] for k in range(n) if not t.label[k])
        score += sum(field.chain[labels[a], labels[b]] for a, b in t.chain.tolist()) + sum(field.skip[labels[a], labels[b]] for a, b in np.concatenate([t.skip, t.told]).tolist())
        out[np.arange(n), labels] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_match_enumeration():
    """Exact on trees, clamped tokens included; close on a loop of weak potentials."""
    draw = np.random.default_rng(12)
    pairs = lambda *x: np.array(x, np.int64).reshape(-1, 2)
    graphs = [
        (pairs((0, 1), (1, 2), (2, 3)), pairs(), pairs(), 1.0, 1e-4),
        (pairs((0, 1), (2, 3)), pairs((0, 2), (2, 4)), pairs(), 1.0, 1e-4),
        (pairs((0, 1)), pairs((1, 2)), pairs((0, 3), (0, 4)), 1.0, 1e-4),
        (pairs((0, 1), (1, 2)), pairs((0, 2)), pairs(), 0.3, 0.02),
    ]
    for chain, skip, told, strength, error in graphs:
        for clamped in (0, 2):
            symmetric = lambda: (lambda m: m + m.T)(draw.normal(0, strength, (pii.LABELS, pii.LABELS)))
            field = pii.Field(draw.normal(0, 1, (pii.HASHED, pii.LABELS)), symmetric(), symmetric())
            n = 5
            label = np.zeros(n, np.int64)
            label[0] = clamped
            blank = np.zeros(n, np.int64)
            t = pii.Tokens(blank, blank, blank, draw.integers(0, pii.HASHED, (n, pii.N_FEATURES)), blank, label, chain, skip, told)
            assert np.abs(field.beliefs(t) - enumerated(field, t)).max() < error


def test_sample_is_bounded(documents, spark):
    rows = corpus()
    assert (pii.fit(documents(rows)).own == pii.fit(documents(rows + [rows[0]] * 500)).own).all()
    assert (pii.fit(documents(rows), max_bytes=0).own[:, 0] == 1).all()
