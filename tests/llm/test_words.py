import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.rules import count_words
from lodestone.llm.words import Words, shingles, slices

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\r#%", max_size=40)), max_size=8)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_match_a_plain_split(texts):
    words = Words(pa.array(texts, pa.string()))
    rows, hashes = shingles(words, 3)
    for i, text in enumerate(texts):
        at = slice(words.first[i], words.first[i + 1])
        assert [words.data[a:b].tobytes().decode() for a, b in zip(words.start[at], words.end[at], strict=True)] == split(text)
        own = [w.translate(LOW) for w in split(text)]
        expected = {tuple(own[k : k + 3]) for k in range(len(own) - 2)} or ({tuple(own)} if own else set())
        assert len(expected) == (rows == i).sum() == len(set(hashes[rows == i].tolist()))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_match_brute_force(texts):
    got = count_words(Words(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        text = text or ""
        words = split(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        repeated = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if split(x)]
        assert [got[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")] == [
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines),
        ]


def test_equal_shingles_hash_equal_across_slices():
    texts = ["x " * 10 + "one two three", "ONE two three", "é" * (1 << 20), "one two three four"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(slices(iter([batch])))
    assert len(parts) > 1 and sum(p.num_rows for p, _ in parts) == len(texts)
    found = [shingles(Words(pa.array([t])), 3)[1] for t in texts]
    assert len(np.intersect1d(found[0], found[1])) == 1 == len(np.intersect1d(found[1], found[3]))
