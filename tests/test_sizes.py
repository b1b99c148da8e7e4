"""What only larger tables, copies and very frequent values show."""

import random

import numpy as np

from lodestone.operators import clusters, extract
from lodestone.operators import documents as D
from lodestone.operators import graph as G
from lodestone.operators import pages as P
from lodestone.operators import vector_index as VI
from lodestone.plans import sources, wiki
from lodestone.plans.tables import spread
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_files_of_a_small_table_are_dealt_over_tasks(spark):
    files = sources._code(spark, DATA)
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(10), "id").count() == 10


def test_calls_broadcast_no_parsed_nodes(spark, monkeypatch):
    """Nodes are stored, so that their size is known before they are joined."""
    names = []
    monkeypatch.setattr(sources, "stored", lambda df, name: names.append(name) or df)
    sources.canonical_calls(spark, DATA)
    assert names == ["calls-nodes", "calls-edges"]


def test_commands_are_dealt_over_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sources, "commands", lambda files: seen.append(files.rdd.getNumPartitions()) or files.withColumn("flags", F.array(F.lit("x"))))
    sources.cli_commands(spark, DATA)
    assert seen[0] > 4


def test_overlapping_pairs_with_frequent_tokens(spark, monkeypatch):
    """Lists of several lengths, some tokens in nearly all; every depth of common tokens is needed."""
    monkeypatch.setattr(P, "MOST_MET", 3)
    rng = random.Random(7)
    rows = [(k, [f"t{min(int(rng.expovariate(0.5)), 9)}" for _ in range(rng.randint(0, 7))], [rng.random() for _ in range(3)]) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, t array<string>, v array<double>")
    for least in (0.5, 0.34, 0.8):
        share = lambda a, b: len(a & b) / len(a | b) if a | b else 0
        want = {(a, b) for a, s, _ in rows for b, t, _ in rows if a < b and share(set(s), set(t)) >= least}
        got = [(r["a"], r["b"]) for r in P.overlapping_pairs(df, "id", "t", "v", least, -1.0).collect()]
        assert sorted(got) == sorted(want) and want


def test_no_frequent_token_joins_its_pages(spark, monkeypatch):
    """What meets are the pages of a few common tokens, not all of one: the plan is run with a count of what it makes."""
    rows = spark.range(2000).select("id", F.array(F.lit("all"), F.concat(F.lit("x"), (F.col("id") % 5).cast("string")), F.concat(F.lit("y"), (F.col("id") % 7).cast("string")), F.concat(F.lit("z"), (F.col("id") % 11).cast("string"))).alias("t"), F.array(F.lit(1.0)).alias("v"))
    out = P.overlapping_pairs(rows, "id", "t", "v", 0.5, -1.0)
    made, want = out.count(), sum(sum((i - j) % p == 0 for p in (5, 7, 11)) >= 2 for i in range(2000) for j in range(i))
    assert made == want


def test_attribution_of_long_and_short_ranges(spark):
    """Ranges inside a bucket, over several, and over very many."""
    rng = random.Random(3)
    length = lambda: rng.choice([rng.randint(0, 40), rng.randint(0, 500), rng.randint(0, 300_000)])
    hunks = [(f"p{k % 3}", rng.randint(0, 60_000), length(), f"s{rng.randint(0, 50)}", rng.randint(0, 30)) for k in range(150)]
    nodes = [(k, f"p{k % 4}", a := rng.randint(0, 60_000), a + length() - 1) for k in range(200)]
    want = {}
    for i, path, start, end in nodes:
        met = [(at, sha) for p, first, n, sha, at in hunks if p == path and n > 0 and first <= end and start <= first + n - 1 and start <= end]
        if met:
            want[i] = (min(met)[1], max(met)[1])
    got = extract.attribution(spark.createDataFrame(nodes, "id int, path string, start_line int, end_line int"), spark.createDataFrame(hunks, "path string, first int, count int, sha string, committed_at int"))
    assert {r["id"]: (r["first_sha"], r["last_sha"]) for r in got.collect()} == want


def test_clusters_of_more_vectors_than_the_product_takes(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST_VECTORS", 10)
    df = spark.range(90).select((F.col("id") % 2).alias("t"), "id", F.array(*(F.when(F.col("id") % 3 == k, 1.0 + F.col("id") % 5).otherwise(0.0) for k in range(3))).alias("v"))
    got = clusters.clustered(df, "t", "id", "v", whole=True).groupBy("t", "cluster").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    assert sorted((r["t"], r["first"], r["n"]) for r in got) == sorted((k % 2, k, 15) for k in range(6)) and all(r["cluster"] >= 0 for r in got)


def test_copies_count_as_so_many_vectors():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.1 * rng.normal(size=(6, 4)) for c in 3 * np.eye(4)])
    n = rng.integers(1, 6, len(x))
    one, all_ = clusters.density_labels(x, counts=n), clusters.density_labels(np.repeat(x, n, axis=0))
    pairs = set(zip(np.repeat(one, n).tolist(), all_.tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_nearest_among_many_copies(spark):
    """More copies of near vectors than codes were kept of: ties go to the smaller ids."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8)).astype(np.float32)
    rows = [(k, base[k % 12].tolist()) for k in range(12 * 40)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = df.where("id < 6").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    got = VI.search_all(VI.vector_index(df, "id", "v"), asked, 50, 999).collect()
    x = np.array([v for _, v in rows], np.float64)
    for q in range(6):
        s = VI._exact(np.broadcast_to(x[q], x.shape), x)
        want = sorted(((-a, k) for k, a in enumerate(s.tolist()) if k != q))[:50]
        assert [r["id"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [k for _, k in want]


def test_overloads_are_listed_once(spark):
    nodes = spark.range(3000).select("id", F.when(F.col("id") < 2990, "same").otherwise(F.col("id").cast("string")).alias("q"), F.col("id").cast("string").alias("s"))
    out = G.dedupe_overloads(nodes, "q", "id", "s")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["q"]: (r["id"], r["overloads"]) for r in out.collect()}
    assert got["same"] == (2989, [str(k) for k in range(2989)]) and got["2995"] == (2995, []) and len(got) == 11


def test_first_place_of_a_fact_in_very_many_files(spark):
    files = spark.range(2000).select(F.format_string("p%04d/requirements.txt", 1999 - F.col("id")).alias("path"), F.concat(F.lit("lib\npandas\nx"), F.col("id").cast("string")).alias("content"))
    out = D.manifest_facts(files)
    assert out._jdf.queryExecution().executedPlan().toString().count("+- Window [") <= 1
    got = {r["value"]: (r["path"], r["line"]) for r in out.collect()}
    assert got["pandas"] == ("p0000/requirements.txt", 2) and got["lib"] == ("p0000/requirements.txt", 1) and len(got) == 30


def test_readmes_are_dealt_over_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(wiki.K, "snapshot", lambda f, s, d, readmes: seen.append(readmes.rdd.getNumPartitions()))
    wiki.repo_snapshot(spark, DATA)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_mentions_of_a_name_that_many_nodes_have(spark, monkeypatch):
    """Each mention meets kinds of nodes, not nodes."""
    nodes = spark.range(2000).select(F.col("id").alias("node_id"), F.lit("run").alias("name"), F.lit("a.run").alias("qualified_name"), F.lit("a/x.py").alias("file_path"), (F.col("id") % 7).alias("start_line"), F.lit("a").alias("package"))
    chunks = spark.range(3).select(F.col("id").alias("chunk_id"), F.lit("a/notes.md").alias("doc_path"), F.lit("See `run` and a.run there").alias("content"))
    met, score = [], P.mention_score
    monkeypatch.setattr(P, "mention_score", lambda raw, *c: met.append(1) or score(raw, *c))
    out = P.link_mentions(chunks, nodes)
    assert "min(struct(start_line" in out._jdf.queryExecution().analyzed().toString() and {(r["chunk_id"], r["raw"], r["node_id"]) for r in out.collect()} == {(k, r, 0) for k in range(3) for r in ("run", "a.run")}
