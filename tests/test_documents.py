import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import clusters
from lodestone.operators import documents as D


def test_density_labels_find_planted_groups():
    draw = np.random.default_rng(1)
    centres = np.eye(8)[:4]
    x = np.concatenate([c + draw.normal(0, 0.02, (15, 8)) for c in centres] + [draw.normal(0, 1, (4, 8))])
    labels = clusters.density_labels(x)
    groups = [set(labels[k * 15 : k * 15 + 15]) for k in range(4)]
    assert all(len(g - {-1}) == 1 for g in groups) and len(set.union(*groups) - {-1}) == 4
    assert (clusters.density_labels(np.ones((2, 3))) == -1).all() and len(clusters.density_labels(np.zeros((6, 3)))) == 6


def test_lead_drops_headings_fences_and_sources(spark):
    md = "# T\nBrief [one](x.md).\n\n## Overview\nBody <!-- no --> text\n```\ncode\n```\nSource: a.py\n## B\nb\n## C\nc\n## D\nd"
    assert spark.range(1).select(D.lead(F.lit(md))).first()[0] == "Brief one. Body text b c"
    assert spark.range(1).select(D.lead(F.lit("word " * 100), 12)).first()[0] == "word word…"


def test_tree_and_steering(spark):
    docs = spark.createDataFrame([(p,) for p in ("b.md", "README.md", "a/z.md", "a/index.md", "a/c/x.md")], "path string")
    got = {(r["parent"], r["sort_order"]): r["path"] for r in D.docs_tree(docs).collect()}
    assert got == {("", 0): "README.md", ("", 1): "a", ("", 2): "b.md", ("a", 0): "a/index.md", ("a", 1): "a/c", ("a", 2): "a/z.md", ("a/c", 0): "a/c/x.md"}
    pages = spark.createDataFrame([(1, "A", None), (2, "B", "A"), (3, "a", None), (4, " ", None), (5, "C", "B"), (6, "D", "D"), (7, "E", "no")], "pos int, title string, parent string")
    assert {r["title"]: r["parent"] for r in D.steering_pages(pages).collect()} == {"A": None, "B": "A", "C": None, "D": None, "E": None}


def test_public_types_and_bodies(spark):
    nodes = spark.createDataFrame([(1, None, "T", "class", "python", 1), (2, 1, "b", "method", "python", 3), (3, 1, "_p", "method", "python", 4), (4, 1, "x", "attribute", "python", 2), (5, None, "hidden", "struct", "go", 1)], "id long, parent_id long, name string, node_type string, language string, start_line int")
    assert [tuple(r) for r in D.public_types(nodes).collect()] == [(1, "T", ["x"], ["b"])]
    files = spark.createDataFrame([("f", "aé€z".encode())], "path string, content binary")
    spans = spark.createDataFrame([(1, "f", 1, 3, "old"), (2, "f", 1, 2, "old"), (3, "gone", 0, 1, "old"), (4, "f", 3, 99, "old")], "id long, file_path string, start_byte long, end_byte long, content string")
    assert {r["id"]: r["body"] for r in D.node_bodies(spans, files).collect()} == {1: "é", 2: "old", 3: "old", 4: "€z"}


def test_citations_repair(spark):
    docs = spark.createDataFrame([(1, "x [[node:a.b]] [[doc:d.md#h]] [[node:a.b]] [[other:q]]")], "id long, text string")
    assert sorted((r["kind"], r["target"]) for r in D.citations(docs, "id", "text").collect()) == [("doc", "d.md#h"), ("node", "a.b")]


def test_links_are_rewritten_outside_code_only():
    from lodestone.operators.wiki import link_names, sane_text

    names = '{"pkg.run": "pkg.run", "run": "pkg.run"}'
    text = "Use `run` or pkg.run, `*pkg.run`.\n```go\npkg.run()\n```\n[pkg.run](x) [[node:pkg.run]] pkg.run.more `other`"
    linked = "Use [[node:pkg.run]] or [[node:pkg.run]], [[node:pkg.run]].\n```go\npkg.run()\n```\n[pkg.run](x) [[node:pkg.run]] pkg.run.more `other`"
    assert link_names(text, names, 30) == (linked, 3)
    assert link_names(text, names, 1) == (text.replace("`run`", "[[node:pkg.run]]", 1), 1) and link_names(None, names, 3) == (None, 0)
    md = "- [A](./gone)\n- [B](./here)\nx [C](./gone) [D](/repos/h/o/n/docs/a/b.md#t) [E](/repos/h/o/n/docs/c/d.md) [F](/repos/h/o/n/docs/slug) [G](/repos/h/o/n/graph/z) [H](/repos/x/y/z/graph/z) [f.go](L3-L9)\n"
    assert sane_text(md, {"here"}, '{"a/b.md": "ab"}', "h/o/n") == "- [B](./here)\nx C [D](/repos/h/o/n/docs/ab#t) E [F](/repos/h/o/n/docs/slug) G [H](/repos/x/y/z/graph/z) f.go:L3-L9\n"


def test_ignore_rules_and_archives(spark, tmp_path):
    import zipfile

    from lodestone.sources import files

    rules = files.ignore_rules("# no\n*.log\n/build/\ndocs/*.tmp\n!keep.log\n**/gen/x.py\n")
    told = {p: files.is_ignored(p, rules) for p in ("a.log", "d/a.log", "keep.log", "build/x.c", "src/build/x.c", "docs/a.tmp", "docs/b/a.tmp", "a/gen/x.py", "gen/x.py", "a.py")}
    assert [p for p, gone in told.items() if gone] == ["a.log", "d/a.log", "build/x.c", "docs/a.tmp", "a/gen/x.py", "gen/x.py"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, text in ((".gitignore", "*.log\n"), ("x.log", "1"), ("x.py", "2")):
            z.writestr(name, text)
    assert {r["path"] for r in files.read_zips(spark, f"file://{tmp_path}").collect()} == {".gitignore", "x.py"}


def test_storage_is_cleared_and_needs_a_shared_folder(spark):
    from pathlib import Path
    from types import SimpleNamespace

    from lodestone.sources import shared

    shared.clear_stored(spark)
    rows = shared.stored(spark.range(5), "check")
    path = Path(shared._kept[spark.sparkContext.applicationId][0][0].removeprefix("file:"))
    bucketed = shared.stored_by(spark.range(5), "check", "id")
    assert rows.count() == bucketed.count() == 5 and path.exists()
    assert shared.clear_stored(spark) == 2 and not path.exists() and shared.clear_stored(spark) == 0
    conf = SimpleNamespace(get=lambda _: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: conf, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)


def test_uuids_match_the_standard_library(spark):
    import uuid

    from pyspark.sql import functions as F

    from lodestone.functions import values

    names = ["", "a", "http://x.y/é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(values.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    seven = spark.range(1).select(values.uuid7(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("k"))).first()[0]
    assert uuid.UUID(seven).version == 7 and uuid.UUID(seven).variant == uuid.RFC_4122


def test_clusters_are_bounded_by_importance_and_gated(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST_VECTORS", 40)
    draw = np.random.default_rng(2)
    rows = [(t, k, [float(x) for x in np.eye(4)[k % 4] + draw.normal(0, 0.01, 4)], float(k < 40)) for t in (0, 1) for k in range(50)]
    df = spark.createDataFrame(rows, "tenant int, id long, v array<double>, importance double")
    got = clusters.clustered(df, "tenant", "id", "v", "importance").collect()
    assert len(got) == 100 and {r["id"] for r in got if r["cluster"] is None} == set(range(40, 50))
    for t in (0, 1):
        label = {r["id"]: r["cluster"] for r in got if r["tenant"] == t and r["id"] < 40}
        assert len({label[k] for k in range(4)}) == 4 and all(label[k] == label[k % 4] for k in range(40))
    tenants = spark.createDataFrame([(0, 15, False), (1, 3, False)], "tenant int, public_surface int, generated boolean")
    labels = spark.createDataFrame([(r["tenant"], r["id"], r["cluster"]) for r in got], "tenant int, id long, cluster long")
    assert {r["tenant"] for r in clusters.worth_showing(labels, tenants, "tenant").collect()} == {0}


def test_ledger_packs_and_what_they_prove(spark):
    from lodestone.operators import wiki as K

    rows = [(1, k, f"r{k % 5}", ["code_node", "file", "doc"][k % 3], f"q{k}", f"f{k}" if k != 4 else None, k if k % 2 else None, k + 1, " a\nb " if k else "x" * 400) for k in range(8)]
    df = spark.createDataFrame(rows, "page int, pos int, record_id string, source string, qn string, file_path string, start_line int, end_line int, snippet string")
    records = K.ledger(df)
    assert sorted(r["pos"] for r in records.collect()) == [0, 1, 2, 3, 4]
    assert {(r["kind"], r["target"]) for r in K.verified(records).collect()} == {("node", "q0"), ("file", "f1"), ("doc", "f2"), ("node", "q3")}
    (whole,) = K.packed(records).collect()
    first = whole["pack"].split("\n\n")[0]
    assert first == f"[r0] node:q0\n  file: f0\n  snippet: {'x' * 320}…" and (whole["n_earlier"], whole["n_cut"]) == (0, 0)
    assert "[r3] node:q3\n  file: f3:3-4\n  snippet: a\n    b" in whole["pack"] and "[r4] file:<unknown>" in whole["pack"]
    (cut,) = K.packed(records, 3, 60).collect()
    assert cut["pack"] == "[r2] doc:f2\n  snippet: a\n    b\n\n... [2 earlier records elided]\n... [2 more records truncated for budget]"
    assert K.packed(records, 3, 1).first()["pack"].strip().startswith("... [2 earlier")


def test_outcomes_and_markers(spark):
    from lodestone.operators import wiki as K

    cases = [("## Open questions\n## Test strategy", [], "open_questions_forbidden"), ("x\n##  TEST STRATEGY \n", ["q"], "test_strategy_forbidden"), ("## comparison with alternatives", [], "comparison_forbidden"), ("### Open questions", ["q"], "partial"), ("## Open questions?", [], "ok"), (None, [], "ok")]
    df = spark.createDataFrame(cases, "text string, missing array<string>, want string")
    for r in df.select("want", K.coverage_outcome(F.col("text"), F.col("missing")).alias("got")).collect():
        assert r["got"] == r["want"]
    text = "<!-- answers: a.b -->x<!-- answers: axb --><!-- answers: c -->"
    got = spark.range(1).select(K.without_markers(F.lit(text), F.array(F.lit("a.b"), F.lit("c")))).first()[0]
    assert got == "x<!-- answers: axb -->"


def test_bodies_of_collections_match_by_stem(spark):
    from lodestone.operators import routing
    from lodestone.operators import token_index as TI

    docs = spark.createDataFrame([(1, "Licensing the work"), (2, "unlicensed"), (3, None), (4, "apache apaches")], "id long, text string")
    of = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (4, "d")], "id long, label string")
    index = TI.token_index(docs, "id", english=True)
    bodies = routing.body_matches(index, "the license Apache", of)
    assert {r["label"]: sorted(r["in_body"]) for r in bodies.collect()} == {"a": ["apache", "license"], "d": ["apache"]}
    rows = spark.createDataFrame([("a", ""), ("b", "the license"), ("c", ""), ("d", "")], "label string, headings string")
    got = {r["label"]: sorted(r["matched"]) for r in routing.route_collections(rows, "the license Apache", 9, bodies=bodies).collect()}
    assert got == {"a": ["apache", "license"], "b": ["license"], "c": [], "d": ["apache"]}
    assert routing.body_matches(index, "the of", of).count() == 0


def plain_clusters(x, least):
    """Sets of rows: components at falling distances, a split into two large parts starts new clusters, and a cluster stays if it has at
    least the mass of what is chosen below it."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(2 - 2 * unit @ unit.T, 0))

    def parts(rows, cut):
        left, out = set(rows), []
        while left:
            todo, own = [left.pop()], set()
            while todo:
                a = todo.pop()
                own.add(a)
                near = {b for b in left if d[a, b] < cut}
                left -= near
                todo += near
            out.append(frozenset(own))
        return out

    def longest(rows):
        """The distance at which these rows, one component below infinity, fall apart."""
        rows = list(rows)
        levels = sorted({d[a, b] for k, a in enumerate(rows) for b in rows[k + 1 :]}, reverse=True)
        return next(level for level in levels if len(parts(rows, level)) > 1)

    def walk(rows, birth, top):
        """(mass chosen, sets chosen) at and below a cluster."""
        mass, now = 0.0, frozenset(rows)
        start = now
        while True:
            if len(now) == 1:
                break
            level = longest(now)
            split = parts(now, level)
            lam = 1 / max(level, 1e-9)
            large = [p for p in split if len(p) >= least]
            if len(large) >= 2:
                mass += len(now) * (lam - birth)
                below = [walk(p, lam, False) for p in large]
                total = sum(b[0] for b in below)
                if not top and mass >= total:
                    return mass, [start]
                return total, [s for b in below for s in b[1]]
            if not large:
                mass += len(now) * (lam - birth)
                break
            mass += (len(now) - len(large[0])) * (lam - birth)
            now = large[0]
        return (0.0, []) if top else (mass, [start])

    return {s for s in walk(range(len(x)), 0.0, True)[1]}


@pytest.mark.parametrize("seed", range(6))
def test_density_labels_by_brute_force(seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(4, 5)) * 2
    x = np.concatenate([c + draw.normal(0, 0.3, (draw.integers(3, 9), 5)) for c in centres] + [draw.normal(size=(5, 5))])
    labels = clusters.density_labels(x)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}} == plain_clusters(x, clusters.MIN_SIZE)


def test_coverage_of_odd_pages_shuffles_by_page_only(spark):
    from lodestone.operators import wiki as K

    mark = lambda q, body: f"<!-- answers: {q} -->\n{body}\n"
    texts = [
        (1, "## A\n" + mark("x", "[[node:a]]") + mark("x", "none") + mark("y", "Source: [m.go](L1)") + "## B\n" + mark("z", "see")),
        (2, "## A\n" + mark("x", "see") + mark("y", "[[doc:d.md#h]]")), (2, "## A\n" + mark("x", "[[node:a]]") + mark("w", "")), (3, None), (4, "no marks"), (None, mark("x", "[[node:a]]")),
    ]
    docs = spark.createDataFrame(texts, "page long, text string")
    required = spark.createDataFrame([(1, "x"), (1, "z"), (1, "v"), (1, None), (2, "x"), (3, "x"), (9, "x"), (None, "x")], "page long, question string")
    verified = spark.createDataFrame([(1, "node", "a"), (1, "file", "m.go"), (2, "node", "a"), (2, "doc", "d.md#h"), (2, "doc", None), (None, "node", "a")], "page long, kind string, target string")
    out = K.coverage(docs, required, verified)
    want = {1: (["x"], ["v", "z"], ["z"], ["y"]), 2: (["x"], [], ["w"], ["w", "y"]), 3: ([], ["x"], [], []), 4: ([], [], [], []), None: ([], [], [], [])}
    assert {r["page"]: tuple(r[1:]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange ") <= 4
