"""Incremental, telemetry, page, access, source and stream operators on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import access, incremental, pages, telemetry
from lodestone.sources import files
from lodestone.streaming import usage


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_incremental_equals_full(spark):
    """Applying the difference of two versions to the old one gives the new one."""
    draw = random.Random(3)
    for _ in range(3):
        old = {k: draw.randint(0, 3) for k in range(40) if draw.random() < 0.7}
        new = {k: draw.choice([v, v + 1]) for k, v in old.items() if draw.random() < 0.8} | {k: 9 for k in range(40, 40 + draw.randint(0, 9))}
        a, b = (spark.createDataFrame([(k, str(v), k) for k, v in x.items()], "k long, h string, id long") for x in (old, new))
        action = dict(rows(incremental.diff(a, b, ["k"], "h")))
        stay = {k: str(v) for k, v in old.items() if action[k] == "keep"}
        todo = {r["k"]: r["h"] for r in incremental.changed(a, b, ["k"], "h").collect()}
        assert stay | todo == {k: str(v) for k, v in new.items()}
        assert set(old) - set(new) == {k for k, v in action.items() if v == "delete"} == {r[0] for r in rows(incremental.orphans(a, b, ["k"]).select("k"))}


def test_merge_and_null_hashes(spark):
    old = spark.createDataFrame([(1, None, 10), (2, "x", 20)], "k long, h string, id long")
    new = spark.createDataFrame([(1, None, 11), (2, "y", 21), (3, "z", 31)], "k long, h string, id long")
    assert rows(incremental.merge(old, new, ["k"], "id", "h").select("k", "id", "action")) == [(1, 10, "keep"), (2, 20, "update"), (3, 31, "insert")]
    assert rows(incremental.changed(old, new, ["k"], "h").select("k")) == [(2,), (3,)]


def test_dirty_reasons_in_order(spark):
    lit, null = F.lit, F.lit(None)
    reason = lambda **x: spark.range(1).select(incremental.dirty_reason(*({"known": lit(True), "version": lit(2), "current_version": 2, "spec": lit("a"), "current_spec": lit("a"), "quality": lit("ok"), "nodes_missing": lit(0), "chunks_missing": lit(0), "nodes_changed": lit(0), "cited": lit("f"), "current_cited": lit("f")} | x).values())).first()[0]
    assert reason() is None and reason(cited=null.cast("string")) is None and reason(quality=lit("partial")) is None
    assert [reason(known=lit(False), version=lit(1)), reason(version=null.cast("int")), reason(spec=lit("b"), quality=null.cast("string")), reason(quality=null.cast("string")), reason(quality=lit("degraded")), reason(nodes_missing=lit(1), chunks_missing=lit(1)), reason(chunks_missing=lit(1)), reason(nodes_changed=lit(2)), reason(cited=lit("g"))] == [
        "missing_row", "schema_version", "spec_changed", "quality_unknown", "quality_degraded", "cited_node_missing", "cited_chunk_missing", "cited_node_content_changed", "cited_evidence_changed",
    ]


def test_cost(spark):
    usage_rows = [("text-embedding-3-small", 30, 0, None), ("gpt-4o-mini", 1000, 500, None), ("nope", 5, 5, None), ("gpt-4o", 0, 0, 0), ("GPT-4o", 100, 0, 500), (None, 1, 1, 1), ("gpt-4", 10, 0, 10)]
    df = spark.createDataFrame([(k, *u) for k, u in enumerate(usage_rows)], "id long, model string, tokens_in long, tokens_out long, tokens_cached long")
    assert [r["cost_micros"] for r in telemetry.cost(df).orderBy("id").collect()] == [1, 450, None, None, 125, None, 300]


def test_percentiles_round_half_even(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 4, 9)] + [("b", 7), ("c", None)], "k string, v long")
    assert rows(telemetry.nearest_rank_by(df, ["k"], "v", (50, 95))) == [("a", 3, 9), ("b", 7, 7)]


def test_sections_and_links(spark):
    md = "# Top\n## A\n```\n## no\n```\n### B\n## C\n## A\n"
    got = rows(pages.sections(spark.createDataFrame([(1, md)], "doc_id long, text string")).select("section", "level", "heading", "first_line", "end_line"))
    assert got == [(1, 2, "A", 2, 6), (2, 3, "B", 6, 6), (3, 2, "C", 7, 7)]
    docs = spark.createDataFrame([("1", "guide/setup.md"), ("2", "api.md")], "id string, source_key string")
    links = spark.createDataFrame([(h,) for h in ("guide/setup.md", "../setup.md", "setup", "x/api.md", "none.md")], "href string")
    assert dict(rows(pages.resolve_links(links, docs))) == {"guide/setup.md": "1", "../setup.md": "1", "setup": "1", "x/api.md": "2", "none.md": None}


def test_mentions_prefer_the_exact_name(spark):
    chunks = spark.createDataFrame([("c", "docs/core/a.md", "Use `core.run` and other.run, or go()")], "chunk_id string, doc_path string, content string")
    nodes = spark.createDataFrame([("1", "run", "core.run", "core/r.py", 4, "core"), ("2", "run", "lib.run", "lib/r.py", 1, "lib"), ("3", "no", "x.no", "x.py", 1, "x")], "node_id string, name string, qualified_name string, file_path string, start_line long, package string")
    assert [(r["raw"], r["node_id"]) for r in pages.link_mentions(chunks, nodes).orderBy("raw").collect()] == [("core.run", "1"), ("other.run", "1")]


def test_word_windows(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    got = pages.word_windows(spark.createDataFrame([(1, text), (2, " a  b "), (3, ""), (4, None)], "id long, text string"), "id", "text").orderBy("id", "chunk_index").collect()
    assert [(r["id"], r["chunk_index"], r["n_words"]) for r in got] == [(1, 0, 512), (1, 1, 512), (1, 2, 104), (2, 0, 2)] and got[3]["content"] == "a  b" and got[1]["content"].startswith("w448 ")


def test_read_scopes(spark):
    table = spark.createDataFrame([(1, "public", False, "x"), (2, "private", False, "x"), (3, "private", False, "me"), (4, "public", True, "x"), (5, "private", False, "x")], "id long, visibility string, deleted boolean, owner string")
    grants, members = spark.createDataFrame([(2, 7), (2, 8), (5, 9)], "resource_id long, group_id long"), spark.createDataFrame([("me", 7), ("me", 8)], "user_id string, group_id long")
    seen = lambda **x: [r[0] for r in rows(access.readable(table, grants, members, **x).select("id"))]
    assert seen() == [1] and seen(public_read=False) == [] and seen(user="me") == [1, 2] and seen(user="me", owner="owner") == [1, 2, 3] and seen(role="owner") == [1, 2, 3, 5]
    assert [r["id"] for r in access.in_given_order([5, 99, 1], table, "id").collect()] == [5, 1]


def test_document_kinds_and_changes(spark):
    paths = {"README.md": "Repo Doc", ".github/workflows/ci.yml": "Workflow", "examples/run.py": "Example", "tests/test_a.py": "Test", "tests/helper.py": None, "Dockerfile": "Config", ".env.local": "Config", "deploy/app.yaml": "Config", "src/a.py": None, "samples/x.md": "Repo Doc"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0]: r[1] for r in df.select("path", files.document_kind(F.col("path"))).collect()} == paths
    feed = spark.createDataFrame([("A\ta.py",), ("R100\told.py\tnew.py",), ("C75\ta.py\tb.py",), ("T\tc",), ("X\tq",)], "value string")
    assert rows(files.changes_of(feed)) == [("A", "a.py", None), ("A", "b.py", None), ("M", "c", None), ("R", "new.py", "old.py")]


def test_tree_scan(spark, tmp_path):
    for name, size in {"a.py": 10, "lib/b.min.js": 5, "node_modules/c.py": 7, "d/e.go": 3, "Makefile": 4, "big.py": (1 << 20) + 1, "big.ts": (1 << 20) + 1, "coverage/f.ts": 4, "empty.py": 0}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    tree = files.read_tree(spark, f"file://{tmp_path}")
    assert [r["path"] for r in files.graph_files(tree).collect()] == ["a.py", "big.py", "d/e.go"]  # the limit holds for scripts only
    assert dict(rows(files.language_bytes(tree))) == {"python": 10, "javascript": 5, "typescript": 4, "go": 3, "makefile": 4}


def test_attribution_by_blame(spark):
    from lodestone.operators import extract

    hunks = spark.createDataFrame([("f", 1, 2, "a", 100), ("f", 3, 1, "b", 50), ("f", 4, 2, "c", 100), ("f", 9, 0, "z", 1)], "path string, first int, count int, sha string, committed_at long")
    nodes = spark.createDataFrame([("n", "f", 2, 4), ("m", "f", 8, 9)], "id string, path string, start_line int, end_line int")
    (r,) = extract.attribution(nodes, hunks).collect()
    assert (r["id"], r["first_sha"], r["last_sha"]) == ("n", "b", "c")


def test_attribution_of_random_ranges(spark):
    """Against every line, with ranges longer than the largest cell."""
    from lodestone.operators import extract

    draw = random.Random(9)
    at, hunks = 1, []
    for k in range(120):
        at += draw.choice([0, 0, 1, 7])
        n = draw.choice([1, 2, 3, 10, 100, 40_000 if k % 40 == 7 else 5])
        hunks.append((f"f{k % 2}", at, n, f"s{draw.randint(0, 50):02}", draw.randint(0, 9)))
        at += n
    nodes = [(k, f"f{draw.randint(0, 2)}", a := draw.randint(1, at), a + draw.choice([-1, 0, 1, 5, 60, 1000, 70_000])) for k in range(150)]
    got = {r["id"]: (r["first_sha"], r["first_at"], r["last_sha"], r["last_at"]) for r in extract.attribution(spark.createDataFrame(nodes, "id int, path string, start_line int, end_line int"), spark.createDataFrame(hunks, "path string, first int, count int, sha string, committed_at int")).collect()}
    want = {}
    for k, path, a, b in nodes:
        met = [(t, s) for p, first, n, s, t in hunks if p == path and first <= b and a <= first + n - 1 and a <= b]
        if met:
            want[k] = (min(met)[1], min(met)[0], max(met)[1], max(met)[0])
    assert got == want


def test_cells_make_up_their_range(spark):
    from lodestone.functions.ranges import TOP, above, cells

    pairs = [(a, b) for a in (0, 1, 5, 7, 16383, 16384, 40000) for b in (a - 1, a, a + 1, a + 30, a + 16384, a + 50001)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("c", cells(F.col("a"), F.col("b"))).withColumn("u", above(F.col("c")))
    for r in df.collect():
        numbers = sorted(x for level, i in r["c"] for x in range(i << level, (i + 1) << level))
        assert numbers == list(range(r["a"], r["b"] + 1)) and sum(level < TOP for level, _ in r["c"]) <= 2 * TOP
        assert {tuple(u) for u in r["u"]} == {(k, i >> (k - level)) for level, i in r["c"] for k in range(level + 1, TOP + 1)}


def replay(times, limit, seconds):
    start, n, out = None, 0, []
    for t in sorted(times):
        if start is None or t >= start + dt.timedelta(seconds=seconds):
            start, n = t, 0
        n += 1
        out.append((t, start, n, n <= limit))
    return out


def test_rate_limit_batch(spark):
    draw = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    events = [(k % 3, base + dt.timedelta(seconds=draw.randint(0, 4000))) for k in range(90)]
    df = spark.createDataFrame(events, "u long, ts timestamp")
    expected = sorted((u, *x) for u in range(3) for x in replay([t for v, t in events if v == u], 4, 600))
    got = sorted((r["u"], r["at"], r["window_start"], r["hit"], r["allowed"]) for r in usage.rate_limited(df, "u", "ts", 4, 600).collect())
    assert [x[:4] for x in got] == [x[:4] for x in expected]


@pytest.mark.parametrize(("kind", "now", "due"), [("hourly", "2024-03-05 10:30:00", "2024-03-05 11:00:00"), ("daily", "2024-03-05 06:00:00", "2024-03-06 06:00:00"), ("daily", "2024-03-05 05:59:00", "2024-03-05 06:00:00"), ("weekly", "2024-03-04 05:00:00", "2024-03-04 06:00:00"), ("weekly", "2024-03-05 05:00:00", "2024-03-11 06:00:00"), ("manual", "2024-03-05 05:00:00", None)])
def test_next_sync(spark, kind, now, due):
    got = spark.range(1).select(F.date_format(usage.next_sync(F.lit(kind), F.lit(now).cast("timestamp"), 6), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == due


def test_zip_source_refuses_what_is_unsafe(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("src/a.py", "x = 1")
        z.writestr("../evil.py", "no")
        z.writestr("bomb.txt", "0" * (2 << 20))
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc/passwd")
    (tmp_path / "b.zip").write_text("not a zip")
    got = {r["path"]: (bytes(r["content"]) if r["content"] is not None else None, r["error"]) for r in files.read_zips(spark, f"file://{tmp_path}").collect()}
    assert got["src/a.py"] == (b"x = 1", None) and got["../evil.py"] == (None, "leaves its folder") and got["link"][1] == "is a link" and got["bomb.txt"][1] == "unpacks too large" and got[""][0] is None
