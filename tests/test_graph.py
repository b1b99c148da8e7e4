import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.operators import graph as G


def graph(spark, pairs, ids=None):
    edges = spark.createDataFrame(pairs, "src string, dst string") if pairs else spark.createDataFrame([], "src string, dst string")
    ids = ids or sorted({x for p in pairs for x in p})
    return edges.withColumn("type", F.lit("calls")), spark.createDataFrame([(i,) for i in ids], "id string")


def ranks(spark, pairs, ids=None):
    return {r["id"]: r["rank"] for r in G.pagerank(*graph(spark, pairs, ids)).collect()}


def test_pagerank_properties(spark):
    assert ranks(spark, [], ["a"]) == {"a": 1.0}
    assert len(set(round(x, 9) for x in ranks(spark, [], list("abcd")).values())) == 1
    chain = ranks(spark, [("a", "b"), ("b", "c")])
    assert chain["a"] < chain["b"] < chain["c"] and sum(chain.values()) == pytest.approx(1)
    loop = ranks(spark, [("a", "a"), ("x", "unknown")], ["a", "b"])
    assert loop["a"] == pytest.approx(loop["b"])


CHAIN = [("caller2", "caller"), ("caller", "root"), ("root", "callee"), ("callee", "callee2")]


def test_bfs_depth_direction_and_cap(spark):
    edges, _ = graph(spark, CHAIN)
    root = spark.createDataFrame([("root",)], "id string")
    at = lambda *a, **b: {r["id"]: r["distance"] for r in G.bfs(edges, root, *a, **b).collect()}
    assert at(1) == {"root": 0, "callee": 1} and at(2) == {"root": 0, "callee": 1, "callee2": 2}
    assert at(2, "callers") == {"root": 0, "caller": 1, "caller2": 2} and len(at(2, "both")) == 5
    assert at(2, "both", max_nodes=3) == {"root": 0, "caller": 1, "callee": 1, "caller2": 2}


def test_canonical_calls(spark):
    nodes = spark.createDataFrame(
        [("m", "pkg.mod", "pkg/mod.py", "python", "module", None, None), ("c", "pkg.mod.C", "pkg/mod.py", "python", "class", "m", None), ("f", "pkg.mod.C.f", "pkg/mod.py", "python", "method", "c", None), ("g", "pkg.S.Get", "s.go", "go", "method", None, "s")],
        "id string, qualified_name string, file_path string, language string, node_type string, parent_id string, receiver string",
    )
    modules = spark.createDataFrame([("pkg/mod.py", "pkg.mod", ["lib.util as u", "lib.log", "x.*", "y as _"])], "file_path string, module string, imports array<string>")
    calls = spark.createDataFrame([("f", "self.g"), ("f", "u.go"), ("f", "log"), ("f", "local"), ("f", "a.b"), ("g", "s.Put")], "src string, raw string")
    got = {r["raw"]: r["target"] for r in G.canonical_calls(calls, nodes, modules).collect()}
    assert got == {"self.g": "pkg.mod.C.g", "u.go": "lib.util.go", "log": "lib.log", "local": "pkg.mod.local", "a.b": "a.b", "s.Put": "pkg.S.Put"}


def test_resolution_needs_one_suffix_match(spark):
    nodes = spark.createDataFrame([(1, "Base", "a.Base"), (2, "Two", "a.Two"), (3, "Two", "b.Two")], "id long, name string, qualified_name string")
    edges = spark.createDataFrame([(9, "inherits", "Base"), (9, "inherits", "Two"), (9, "calls", "Base"), (9, "calls", "b.Two"), (9, "calls", "b.Two")], "src long, type string, target string")
    got = {(r["type"], r["target"]): r["dst"] for r in G.resolve(edges, nodes).collect()}
    assert got == {("inherits", "Base"): 1, ("inherits", "Two"): None, ("calls", "Base"): None, ("calls", "b.Two"): 3}


CODE = "import os\nfrom .util import go as g\n\nclass A(Base):\n    X = 1\n\n    @router.get('/')\n    def run(self):\n        def inner():\n            g()\n        return inner()\n\nLIMIT = 2\n"


def test_python_extraction(spark):
    files = spark.createDataFrame([("p/__init__.py", CODE), ("bad.py", "def ("), ("empty.py", "")], "path string, content string")
    nodes = {r["qualified_name"]: r for r in extract.python_nodes(files).collect()}
    assert {k: r["node_type"] for k, r in nodes.items()} == {"p": "module", "p.A": "class", "p.A.X": "attribute", "p.A.run": "method", "p.LIMIT": "constant", "bad": "module", "empty": "module"}
    assert nodes["bad"]["error"].startswith("SyntaxError") and (nodes["p.A.run"]["start_line"], nodes["p.A.run"]["end_line"]) == (7, 11)
    edges = {(r["source"], r["type"], r["target"]) for r in extract.python_edges(files).collect()}
    assert {("p", "imports", "os"), ("p", "imports", ".util.go as g"), ("p.A", "inherits", "Base"), ("p", "declares", "p.A"), ("p.A.run", "calls", "g"), ("p.A.run", "calls", "inner")} <= edges
    role = extract.python_nodes(files).select("qualified_name", extract.role(F.col("node_type"), F.col("name"), F.col("decorators"), F.col("bases")).alias("r"))
    assert {r[0]: r[1] for r in role.collect()}["p.A.run"] == "entry_point"


def test_markdown_chunks_keep_content_and_limits():
    text = "# A\nintro\n## B\n" + "word " * 300 + "\n```\n" + "code\n" * 300 + "```\n| a |\n| b |\n## C\ntail"
    chunks = extract.markdown_chunks(text, most=500, least=100)
    assert [k for k, _, _ in chunks] == list(range(len(chunks))) and "".join(re_ws(c) for _, _, c in chunks) == re_ws(text)
    assert any(c.count("```") == 2 for _, _, c in chunks) and chunks[0][1] == ["A"]
    assert len(extract.markdown_chunks("# x\n" * 40, most=2, least=0, most_chunks=5)) == 5 and extract.markdown_chunks("") == []


def re_ws(text):
    return "".join(text.split())


def test_go_and_typescript_edges(spark):
    from lodestone.operators import code
    from lodestone.plans import sources

    _GO, _TS = (x.replace("^", "") for x in (sources._GO, sources._TS))
    files = spark.createDataFrame([("s/store.go", _GO, "go"), ("app/main.ts", _TS, "typescript"), ("x.py", "def f(): pass", "python"), ("empty.ts", None, "javascript"), ("cut.go", "package p\nfunc broken( {\n\"", "go")], "path string, content string, language string")
    edges = {(r["source"], r["type"], r["target"]) for r in code.edges(files).collect()}
    assert {("s.Store.Get", "calls", "s.load"), ("s.Store", "inherits", "s.Base"), ("app.main.A.run", "calls", "this.step"), ("app.main.A.run", "calls", "deep"), ("app.main", "imports", "lib.util as util")} <= edges
    assert not {t for _, k, t in edges if k == "calls"} & {"if", "func", "return", "super", "no"}
    assert {r["qualified_name"] for r in code.nodes(files).where("node_type = 'module'").collect()} == {"s.store#module", "app.main", "empty", "cut#module"}


def test_pagerank_rule_matches_plain_iteration(spark):
    import random

    draw = random.Random(3)
    pairs = sorted({(f"n{draw.randrange(30)}", f"n{draw.randrange(40)}") for _ in range(120)})
    pairs = [p for p in pairs if p[0] != p[1]]
    ids = sorted({x for p in pairs for x in p})
    out = {i: [d for s, d in pairs if s == i] for i in ids}
    rank = {i: 1 / len(ids) for i in ids}
    for _ in range(200):
        loose = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / len(ids) + 0.85 * (loose / len(ids) + sum(rank[s] / len(out[s]) for s in ids if i in out[s])) for i in ids}
    got = ranks(spark, pairs)
    assert sum(abs(got[i] - rank[i]) for i in ids) < 1e-5


def test_hubs_are_spread_and_change_nothing(spark, monkeypatch):
    """One source of 100,000 links: several files, and the ranks and distances of a layout without hubs."""
    edges = spark.range(100_000).selectExpr("cast(0 as long) src", "id + 1 dst", "'calls' type").union(spark.createDataFrame([(1, 200_000, "calls"), (200_000, 0, "calls"), (7, 200_001, "calls")], "src long, dst long, type string"))
    nodes = spark.range(200_002).where("id <= 100000 or id >= 200000")
    roots = spark.createDataFrame([(200_000,)], "id long")
    found = {}
    for degree in (10**9, 1000):
        monkeypatch.setattr(G, "HUB_DEGREE", degree)
        ranks = {r["id"]: round(r["rank"], 12) for r in G.pagerank(edges, nodes, rounds=4).collect()}
        capped = sorted(map(tuple, G.bfs(edges, roots, 3, "both", 50).collect()))
        found[degree] = ranks, sorted(map(tuple, G.bfs(edges, roots, 3, "callees").collect())), capped
    assert found[10**9] == found[1000] and len(found[1000][1]) == 100_003
    links = G._Links(edges.selectExpr("src at", "dst"), "test")
    assert links.n_hubs == 1 and len(links.of_hubs.inputFiles()) > 1 and links.of_hubs.count() == 100_000
    plan = links.joined(roots)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
