"""Stages keep every column of documents, also those named like their own working columns."""

import pytest

from lodestone.llm import decontam, mixing, neardup, pii, toxicity
from lodestone.llm.shared import free_names

#: Working names of the stages, as they are, with underscores and in capitals.
NAMES = ["toxicity", "score", "copy", "copied", "doc", "text_hash", "rep", "key", "component", "kept", "item_id", "coverage", "n_tiles", "n_items", "digest", "item", "of_text", "of_best", "contaminated", "label", "place", "start", "part", "n_blocks", "taken", "span"]


def wide(documents, spark):
    item = "one two three four five six seven eight"
    rows = [(k, f"plain words number {k} about nothing at all in row {k * 7} of {k * 13} here", f"s{k % 2}") for k in range(12)]
    rows += [(20, f"before {item} after", "s0"), (21, rows[3][1], "s0"), (22, "mail me at a.b@example.com now please and thanks", "s1"), (23, None, None)]
    names = [x for n in NAMES for x in (n, f"_{n}", f"__{n}".upper())]
    df = documents(rows).selectExpr("*", *(f"{k} as `{n}`" for k, n in enumerate(names)))
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(12)], "doc_id long, quality int, toxic int")
    return df, labels, spark.createDataFrame([(1, item)], "item_id long, text string")


def test_free_names_differ_in_any_case():
    assert free_names(["A", "_a", "b"], "a", "B", "c", "a") == ["__a", "_B", "c", "___a"]


@pytest.mark.parametrize("stage", ["toxicity", "neardup", "decontam", "decontam_shuffled", "pii", "mixing"])
def test_all_columns_stay(documents, spark, stage):
    df, labels, items = wide(documents, spark)
    got = {
        "toxicity": lambda: toxicity.drop_toxic(df, labels),
        "neardup": lambda: neardup.drop_near_duplicates(df),
        "decontam": lambda: decontam.drop_contaminated(df, items),
        "decontam_shuffled": lambda: decontam.drop_contaminated(df, items, broadcast_words=0),
        "pii": lambda: pii.redact(df),
        "mixing": lambda: mixing.mixture(df),
    }[stage]()
    ids = sorted(r["doc_id"] for r in got.select("doc_id").collect())
    if stage == "mixing":
        assert sorted(c for c in got.columns if c not in ("size", "taken")) == sorted(c for c in df.columns if c not in ("size", "taken"))
        return
    assert got.columns == df.columns
    assert {"toxicity": len(ids) > 0, "neardup": 21 not in ids and 3 in ids, "decontam": 20 not in ids and len(ids) == 15, "decontam_shuffled": 20 not in ids and len(ids) == 15, "pii": len(ids) == 16}[stage]
    first = got.where("doc_id = 1").first()
    want = df.where("doc_id = 1").first()
    assert first is None or tuple(first) == tuple(want)
