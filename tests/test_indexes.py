"""Indexes give the rows of a scan, read only what they must, and are built once for a source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import gram_index as GI
from lodestone.operators import retrieval as R
from lodestone.operators import token_index as TI
from lodestone.operators import vector_index as VI
from lodestone.sources import indexes


def rows(df):
    return sorted((r[0], round(r[1], 9)) for r in df.collect())


def texts(seed=3, n=300):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "license", "LICENSES", "licensing", "a", "of", "zebra", "x1", "naïve", "İstanbul", "K", "running", "ran", "42"]
    out = [(k, " ".join(rng.choice(words, rng.integers(0, 9))), f"{rng.choice(words)} head") for k in range(n)]
    return out + [(1000, None, "the license"), (1001, "", None), (1002, "the-license_the\nlicense", "license"), (None, "the license", "lost")]


@pytest.fixture(params=[1024, 16])
def docs(spark, request, monkeypatch, tmp_path):
    monkeypatch.setattr(TI, "BLOCK_DOCS", request.param)
    path = str(tmp_path / "docs")
    spark.createDataFrame(texts(), "id long, text string, title string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


QUERIES = ["license", "the license", "the license of", "zebra", "absent", "the absent", "", "naïve", "42 x1", "The THE"]


def test_words_as_by_scan(docs):
    known = docs.where("id is not null")
    index = TI.token_index(docs, "id")
    fields = {"A": "title", "D": "text"}
    both = TI.token_index(docs, "id", fields)
    stems = TI.token_index(docs, "id", english=True)
    for q in QUERIES:
        for k in (5, None):
            assert rows(TI.search(index, q, k)) == rows(R.lexical_stream(known, q, k, "id")), q
            assert rows(TI.search(both, q, k)) == rows(R.lexical_stream(known, q, k, "id", fields)), q
            assert rows(TI.search(stems, q, k)) == rows(R.lexical_stream_english(known, q, k, "id")), q
    for q in ["icens", "the lic", "zebra", "ebr x", "...", "absent"]:
        assert rows(TI.with_substring_fallback(index, docs, q, 12, "id")) == rows(R.with_substring_fallback(known, q, 12, "id")), q


def test_stems_are_searched_in_the_index_of_words(docs, monkeypatch):
    """No second index is built; forms of a stem count together, in all fields and after changes, and function words take no place."""
    spark, fields = docs.sparkSession, {"A": "title", "D": "text"}
    TI.token_index(docs, "id"), TI.token_index(docs, "id", fields)
    monkeypatch.setattr(TI, "postings", None)
    stems, both = TI.token_index(docs, "id", english=True), TI.token_index(docs, "id", fields, english=True)
    assert stems.forms(["licens", "run"]) == {"license": "licens", "licenses": "licens", "licensing": "licens", "running": "run"}
    monkeypatch.undo()
    known = docs.where("id is not null")
    for q in ["licensing", "a zebra running", "license of the zebras x1", "runs licensed", "ran the Zebra", "licensing absently", "the a of"]:
        assert rows(TI.search(stems, q, None)) == rows(R.lexical_stream_english(known, q, None, "id")), q
    n = lambda c: F.size(F.filter(TI.T.tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: t.isin("license", "licenses", "licensing")))
    want = known.select("id", n("title").alias("a"), n("text").alias("d")).where("a + d > 0")
    assert rows(TI.search(both, "licensed", None)) == rows(want.select("id", F.col("a") * 1.0 + F.col("d") * 0.1)) and rows(TI.holding(both, "licensed")) == rows(want.selectExpr("id", "a + d"))
    new = spark.createDataFrame([(5, "a licensing zebra"), (9000, "licensed of the zebra")], "id long, text string")
    changed = TI.with_changes(stems, new, "id", removed=spark.createDataFrame([(1002,)], "id long"))
    now = known.select("id", "text").where("id not in (5, 1002)").union(new)
    for q in ["licensing", "zebra license"]:
        assert rows(TI.search(changed, q, None)) == rows(R.lexical_stream_english(now, q, None, "id")), q


def test_a_query_reads_its_tokens_folders_and_no_text(docs):
    index = TI.token_index(docs, "id")
    plan = TI.search(index, "the license", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "text" not in plan.split("ReadSchema:")[1].split(">")[0]


def test_only_blocks_that_can_hold_the_best_are_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(TI, "BLOCK_DOCS", 8)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, "word " * (1 + k % 50)) for k in range(400)], "id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    index = TI.token_index(docs, "id")
    assert index.blocks == 50
    kept = TI._single(index, "word", 3)
    assert rows(R.top(kept, 3)) == rows(R.lexical_stream(docs, "word", 3, "id")) and kept.count() < 200


def test_changes_hide_what_they_replace(spark, docs):
    index = TI.token_index(docs, "id")
    new = spark.createDataFrame([(5, "the license now"), (9000, "a license of the zoo")], "id long, text string")
    changed = TI.with_changes(index, new, "id", removed=spark.createDataFrame([(1002,), (7,)], "id long"))
    again = TI.with_changes(changed, spark.createDataFrame([(9000, "nothing here")], "id long, text string"), "id")
    base = docs.select("id", "text").where("id is not null and id not in (5, 7, 1002)")
    for i, extra in ((changed, new), (again, new.where("id = 5"))):
        want = base.unionByName(extra)
        for q in ("the license", "license", "nothing here", "zoo"):
            expected = rows(R.lexical_stream(want.unionByName(spark.createDataFrame([(9000, "nothing here")], "id long, text string")) if i is again else want, q, None, "id"))
            assert rows(TI.search(i, q, None)) == expected, q
    n = {r["token"]: r["n_docs"] for r in TI.lexicon(again).collect()}
    assert n["nothing"] == 1 and "zoo" not in n


def test_an_index_is_built_once_and_again_for_new_files(spark, tmp_path, monkeypatch):
    path, built = str(tmp_path / "rows"), []
    spark.range(5).write.parquet(path)

    def make(source, **parameters):
        return indexes.kept(source, "test", lambda: built.append(1) or source.selectExpr("id", "id % 2 as folder"), by=("folder",), **parameters)

    for _ in range(2):
        assert sorted(r["id"] for r in make(spark.read.parquet(path)).collect()) == list(range(5))
    assert len(built) == 1
    make(spark.read.parquet(path), other=1)
    make(spark.read.parquet(path).where("id > 2"))
    assert len(built) == 3
    spark.range(7).write.mode("overwrite").parquet(path)
    assert make(spark.read.parquet(path)).count() == 7 and len(built) == 4
    make(spark.range(3)), make(spark.range(3))
    assert len(built) == 6


def test_names_as_by_scan(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = ["red", "Red-widget", "widget", "blue_widget", "get", "WIDGETS", "é", "r2", "", "a b"]
    path = str(tmp_path / "names")
    spark.createDataFrame([(k, " ".join(rng.choice(words, rng.integers(0, 4)))) for k in range(200)] + [(900, None)], "id long, name string").write.parquet(path)
    names = spark.read.parquet(path)
    index = GI.gram_index(names, "id", "name")
    for q in ("red widget", "widget", "r2", "", "zzz", "Widgets"):
        for least in (0.05, 0.3, 0.9):
            assert rows(GI.similar(index, q, 20, least)) == rows(R.symbol_stream(names, q, 20, "id", "name", least)), (q, least)
    for q in ("widg", "DGET", "d-wid", "re", "é", "", "nothing", "red-widget r"):
        want = sorted(r[0] for r in names.where(F.lower("name").contains(q.lower())).collect())
        assert sorted(r["id"] for r in GI.holding(index, names, q, "id", "name").collect()) == want, q
    with pytest.raises(ValueError):
        GI.similar(index, "widget", 5, 0.0)


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 12))
    vectors = {k: (centres[k % 20] + 0.3 * rng.standard_normal(12)).astype(np.float32).tolist() for k in range(2400)}
    path = str(tmp_path / "vectors")
    odd = [(9000, None), (9001, [0.0] * 12), (9002, [1.0, 2.0]), (9003, [float("nan")] * 12), (None, [1.0] * 12)]
    spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<float>").repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    index = VI.vector_index(table)
    assert index.rows.count() == 2400 and index.codec.probes < len(index.codec.centres) / 2
    for q in (0, 77):
        want = rows(R.vector_stream(table.where("vec_id < 9000"), vectors[q], 10))
        assert rows(VI.search(index, vectors[q], 10, 999)) == want
        assert len({r[0] for r in rows(VI.search(index, vectors[q], 10))} & {r[0] for r in want}) >= 9
    asked = table.where("vec_id % 20 = 0 and vec_id < 9000").selectExpr("vec_id as query", "embedding as vector")
    everything, some = (VI.search_all(index, asked, 10, p).collect() for p in (999, None))
    exact = {(r["query"], r["id"]) for r in everything}
    assert len(exact) == 1200 and len({(r["query"], r["id"]) for r in some} & exact) >= 0.9 * len(exact)
    one = [(r["id"], round(r["score"], 9)) for r in sorted((r for r in everything if r["query"] == 20), key=lambda r: r["rank"])]
    near = sorted(R.vector_stream(table.where("vec_id < 9000 and vec_id <> 20"), vectors[20], 10).collect(), key=lambda r: (-r["score"], r["id"]))
    assert one == [(r["id"], round(r["score"], 9)) for r in near]
    with pytest.raises(ValueError):
        VI.vector_index(table.where("vec_id = 9001"))


def test_postings_are_flat_and_short(spark):
    """A posting takes an id, a count and its packed places; nested arrays took some 110 bytes of a row that is shuffled and sorted."""
    texts = [(k, " ".join(f"w{(k + j) % 40}" for j in range(60))) for k in range(64)]
    rows = TI.postings(spark.createDataFrame(texts, "id long, text string"), "id", {"D": "text"}, 1, 8)
    assert not any("struct" in t for _, t in rows.dtypes)
    n_docs, n, taken = rows.agg(F.sum("n_docs"), F.sum("n"), F.sum(8 * F.size("ids") + 4 * F.size("counts") + F.octet_length("steps"))).first()
    assert n == 64 * 60 and taken <= 16 * n_docs


def test_places_are_packed_without_loss():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 268_435_455, 268_435_456, 2**31 - 1])
    data, at = TI._packed(values)
    assert TI._unpacked(data.tobytes()).tolist() == values.tolist() and np.diff(at).tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert len(TI._packed(values[:0])[0]) == 0 and len(TI._unpacked(b"")) == 0


def test_stems_of_a_block_are_those_of_each_word():
    """Only what ends in a letter goes through the rules; the rest are their own stems."""
    import pyarrow as pa

    from lodestone.functions.stem import stem

    words = ["licensing", "the", "1st", "x1", "42", "running7", "yyy", "y1y", "s", "ponies", "a1", "ties"]
    assert TI._stems(pa.array(words, pa.large_string())).to_pylist() == [None if w == "the" else stem(w) for w in words]


def test_trigrams_are_sorted_in_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    """All trigrams of a folder were sorted in one task, so that its memory grew with the names."""
    monkeypatch.setattr(GI, "TASK_BYTES", 64)
    path, tasks = str(tmp_path / "names"), []
    spark.createDataFrame([(k, f"red widget {k % 7} of {k}" if k % 5 else None) for k in range(60)], "id long, name string").write.parquet(path)
    names = spark.read.parquet(path)
    monkeypatch.setattr(GI, "kept", lambda source, name, build, /, **_: tasks.append(build()) or tasks[-1])
    index = GI.gram_index(names, "id", "name")
    plan = tasks[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")  # lists are dealt, not trigrams
    assert rows(GI.similar(index, "red widget", None)) == rows(R.symbol_stream(names.where("name is not null"), "red widget", None, "id", "name"))
