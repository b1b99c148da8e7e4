"""Entries in texts against ``in``, with the dictionary at once and in shards."""

import random

import pytest

from lodestone.operators import dictionary


@pytest.mark.parametrize("shard_bytes", [dictionary.SHARD_BYTES, 150])
def test_occurring_entries(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(dictionary, "BLOCK_BYTES", 400)
    draw = random.Random(4)
    letters = "abé日"
    texts = [(k, "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))) for k in range(80)] + [(900, None), (901, ""), (902, "ab" * 3000)]
    entries = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) for _ in range(60)] + ["", None, "ab", "ab", "baba"]
    got = dictionary.occurring(spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame([(e,) for e in entries], "entry string"), shard_bytes).collect()
    want = {(k, e) for k, t in texts for e in entries if t and e and e in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_dictionary(spark):
    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    assert dictionary.occurring(texts, spark.createDataFrame([], "entry string")).count() == 0
