"""Planning and checking of generated pages: topics, quotas, plans, evidence, links and quality."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T
from lodestone.functions import values as V
from lodestone.operators import pages as P
from lodestone.operators.dictionary import occurring

# Document names and their tiers, path patterns, words that are never linked, page numbers and caps.
PUBLIC_DOCS = (
    "usage", "guide", "tutorial", "quickstart", "quick-start", "getting-started", "getting_started", "cli", "api", "reference", "examples",
    "architecture", "overview", "readme",
)
NO_TOPIC_DOCS = (
    "contributing", "development", "developing", "release", "releases", "changelog", "license", "code_of_conduct", "code-of-conduct", "security",
    "testing", "ci",
)
DOC_PATH = r"(?i)^(?:README(?:\.[a-zA-Z]+)?|docs?/.+\.(?:md|rst|markdown))$"
ROOT_DOC = r"(?i)^README(\.[a-zA-Z]+)?$"
TEST_PATH = r"(?i)(?:^|/)(?:[^/]+_test\.go|test_[^/]+\.py|[^/]+_test\.py|[^/]+\.test\.[jt]sx?|[^/]+\.spec\.[jt]sx?|[^/]+_spec\.rb)$|(?:^|/)(?:tests?|__tests__|testdata|fixtures?|golden|snapshots?|__snapshots__|mocks?|stubs)(?:/|$)"
INTERNAL_PATH, CMD_PATH = r"(?:^|/)internal(?:/|$)", r"^cmd(?:/|$)"
PUBLIC_PATH = r"(?i)^(?:cmd|examples?|sample[s]?|docs?)(?:/|$)"
GENERATED_PATH = r"(?i)(?:^|/)(?:gen|generated|\.gen|dist|build|out)(?:/|$)|_generated\.[a-zA-Z]+$|\.pb\.go$|^zz_generated\."
SCAFFOLDING = r"(?i)(?<![a-zA-Z])(?:fixture|golden|snapshot|comparator|regression|harness|mock|stub)(?![a-zA-Z])"
SECOND_SEGMENT = ("cmd", "internal", "pkg", "lib", "src", "app")
TEST_FOLDERS = ("tests", "test", "__tests__", "testdata", "fixtures", "fixture", "golden", "snapshots", "__snapshots__", "mocks", "stubs")
EXAMPLE_FOLDERS = ("examples", "example", "sample", "samples")
HEADING_SCORE = {"public": 0.85, "supporting": 0.45}
BASE_PAGES, PUBLIC_RATIO, SUPPORTING_RATIO, LEAST_PAGES, MOST_PAGES, CLUSTER_CAP = 6, 1.3, 0.4, 5, 30, 4
PLAN_MOST, LOW_CONFIDENCE, AUTO_LINKS = 25, 0.05, 30
NEVER_LINKED = (
    "any", "Array", "bool", "Boolean", "byte", "Dict", "Error", "Exception", "False", "float32", "float64", "int", "int32", "int64", "List", "Map",
    "nil", "None", "Number", "Object", "rune", "Set", "String", "string", "true", "True", "uint", "uint32", "uint64",
)
UNTOUCHED = r"```[a-zA-Z0-9_+-]*\n.*?\n```|\[\[(?:node|doc):[^\]]+\]\]|\[[^\]]*?\]\([^)\n]+\)"
BACKTICKED, DOTTED = r"`([^`\n]+?)`", r"(?<![\w.])[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+(?!\w|\.\w)"
MARKDOWN_LINK, SIBLING = r"\[([^\]\n]+?)\]\(([^)\s]+)\)", r"\./([a-z0-9][a-z0-9-]*)"
SIBLING_BULLET = r"\s*[-*+]\s+\[[^\]\n]+\]\(\./([a-z0-9][a-z0-9-]*)\)\s*[\.\,;:!\-—–]*\s*"
RAW_DOCS, RAW_GRAPH, LINE_RANGE = r"/repos/([^/]+/[^/]+/[^/]+)/docs/(.+)", r"/repos/([^/]+/[^/]+/[^/]+)/graph/.+", r"(?i)L\d+(?:-L?\d+)?"


# ---- Topics -------------------------------------------------------------------------------------------------------


def doc_headings(docs: DataFrame) -> DataFrame:
    """(path, line, level, heading, tier) of documents that can give topics."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    kept = docs.where(F.col("path").rlike(DOC_PATH) & ~stem.isin(*NO_TOPIC_DOCS)).withColumn("tier", F.when(stem.isin(*PUBLIC_DOCS), "public").otherwise("supporting"))
    lines = P.markdown_lines(kept.select(F.struct("path", "tier").alias("doc"), "content"), "doc", "content")
    shape = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    heads = lines.where(~F.col("fenced") & F.col("content").rlike(shape))
    return heads.select("doc.path", "line", F.length(F.regexp_extract("content", shape, 1)).alias("level"), F.trim(F.regexp_extract("content", shape, 2)).alias("heading"), "doc.tier")


def docs_outline(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(key, title, path, score, tier, demoted): topics of first and second headings, once each.

    docs(path, content); names(name): symbols and paths. A public heading is demoted if none of its words (four
    letters or more) occurs in a name. One automaton of all headings' words reads each name once.
    """
    heads = doc_headings(docs).where("level <= 2")
    key = F.concat(F.lit("docs:"), "path", F.lit("#"), F.regexp_replace(F.regexp_replace(F.lower("heading"), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    first = P.first_per_group(heads.withColumn("key", key), "key", "path", "line")
    words = F.filter(F.regexp_extract_all(F.lower("heading"), F.lit("[a-z][a-z0-9_-]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(*T.ROUTING_STOPWORDS))
    asked = first.select("key", F.explode(F.array_distinct(words)).alias("entry"))
    low = names.select(F.lit(0).alias("id"), F.lower("name").alias("text")).distinct()
    held = occurring(low, asked.select("entry")).select("entry").distinct()
    known = asked.join(held, "entry").select("key").distinct().withColumn("known", F.lit(True))
    out = first.join(known, "key", "left").withColumn("demoted", (F.col("tier") == "public") & F.col("known").isNull())
    tier = F.when(F.col("demoted"), "supporting").otherwise(F.col("tier"))
    return out.select("key", F.col("heading").alias("title"), "path", V.literal_map({k: str(v) for k, v in HEADING_SCORE.items()})[tier].cast("double").alias("score"), tier.alias("tier"), "demoted")


def file_cluster(path: Column) -> tuple[Column, Column]:
    """(key, title) of the cluster that a file belongs to, by its first folders."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    head, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    low = F.lower(head)
    rules = (
        (F.size(parts) == 0, F.lit("root:"), F.lit("(root)")),
        ((F.size(parts) == 1) & head.rlike(ROOT_DOC), F.concat(F.lit("root:"), head), head),
        (F.size(parts) == 1, F.lit("root"), F.lit("(root files)")),
        (low == "internal", F.concat(F.lit("internal:"), second), F.concat(F.lit("internal/"), second)),
        (low.isin(*SECOND_SEGMENT), F.concat(low, F.lit(":"), second), second),
        (low.isin(*TEST_FOLDERS), F.concat(F.lit("tests:"), low), low),
        (low.isin(*EXAMPLE_FOLDERS), F.lit("examples"), F.lit("examples")),
        (low.isin("docs", "doc"), F.lit("docs"), F.lit("docs")),
    )
    key, title = F.concat(F.lit("pkg:"), head), head
    for when, k, t in reversed(rules):
        key, title = F.when(when, k).otherwise(key), F.when(when, t).otherwise(title)
    return key, title


def topics(files: DataFrame, symbols: DataFrame, readmes: DataFrame) -> DataFrame:
    """(repo, key, title, score, tier, kind) of each cluster of files.

    files(repo, path), symbols(repo, qualified_name, file_path), readmes(repo, readme). A cluster's first file that is
    no test tells its place; clusters of tests only score nothing.
    """
    key, title = file_cluster(F.col("path"))
    is_test, w = F.col("path").rlike(TEST_PATH), P.SALIENCE
    rows = files.select("repo", "path", key.alias("key"), title.alias("title"), is_test.alias("is_test"))
    public = symbols.where(~F.col("file_path").rlike(INTERNAL_PATH) & ~F.col("file_path").rlike(TEST_PATH)).select("repo", F.col("file_path").alias("path")).distinct().withColumn("exports", F.lit(True))
    seen = rows.join(public, ["repo", "path"], "left").groupBy("repo", "key", "title").agg(
        F.min(F.when(~F.col("is_test"), F.col("path"))).alias("at"), F.coalesce(F.bool_or(F.col("exports") & ~F.col("is_test")), F.lit(False)).alias("exports"), F.bool_or(F.col("path").rlike(GENERATED_PATH)).alias("generated")
    )
    heads = F.lower(F.array_join(F.regexp_extract_all("readme", F.lit(r"(?m)^#{1,6}\s+(.*)$"), F.lit(1)), "\n"))
    fences = F.lower(F.array_join(F.regexp_extract_all("readme", F.lit(r"```[\s\S]*?```"), F.lit(0)), "\n"))
    told = readmes.select("repo", F.lower("readme").alias("all"), heads.alias("heads"), fences.alias("fences"))
    r = seen.join(told, "repo", "left")
    name = F.lower(F.trim("title"))
    told_by = lambda c: F.coalesce(F.col(c).contains(name), F.lit(False)) & (name != "")
    score = (
        F.when(F.col("at").rlike(CMD_PATH), w["cmd_root"]).when(F.col("at").rlike(PUBLIC_PATH), w["public_path"]).otherwise(0.0)
        + F.when(F.col("at").rlike(INTERNAL_PATH), w["internal_path"]).otherwise(0.0) + F.when(F.col("at").rlike(GENERATED_PATH), w["generated_path"]).otherwise(0.0)
        + F.when(F.col("exports"), w["exported"]).otherwise(0.0) + F.when(F.col("title").rlike(SCAFFOLDING) | F.col("key").rlike(SCAFFOLDING), w["test_name"]).otherwise(0.0)
        + F.when(told_by("heads"), w["readme_heading"]).when(told_by("fences"), w["readme_code"]).when(told_by("all"), w["readme_inline"]).otherwise(0.0)
    )
    score = F.when(F.col("at").isNull(), 0.0).otherwise(F.round(score, 4))
    k = F.col("key")
    kind = (
        F.when(F.col("at").isNull(), "test_scaffolding").when(k.startswith("cmd:"), "cli_command").when(k == "examples", "example").when((k == "docs") | k.startswith("root:README"), "docs_topic").when(k.startswith("tests:"), "test_scaffolding")
        .when(k.startswith("internal:"), "module_cluster").when(F.col("generated"), "generated_output").when(F.col("exports"), "public_api").otherwise("module_cluster")
    )
    return r.select("repo", "key", "title", score.alias("score"), kind.alias("kind")).withColumn("tier", P.salience(F.col("score")))


def quotas(candidates: DataFrame) -> DataFrame:
    """(repo, public, supporting, eligible, target) of candidates(repo, key, tier, kind, score)."""
    n = lambda c: F.count_if(c)
    out = candidates.groupBy("repo").agg(n(F.col("tier") == "public").alias("public"), n(F.col("tier") == "supporting").alias("supporting"), n(P.eligible(F.col("tier"), F.col("kind"), F.col("score"))).alias("eligible"))
    raw = F.lit(BASE_PAGES) + F.ceil(F.col("public") * PUBLIC_RATIO) + F.ceil(F.col("supporting") * SUPPORTING_RATIO)
    return out.withColumn("target", F.least(F.lit(MOST_PAGES), F.greatest(F.lit(LEAST_PAGES), raw)).cast("long"))


def dedicated(candidates: DataFrame, cap: int = CLUSTER_CAP) -> DataFrame:
    """Candidates that may have a page of their own, ``cap`` of each cluster prefix, with their ``place`` in it."""
    rows = candidates.where(P.eligible(F.col("tier"), F.col("kind"), F.col("score"))).withColumn("cluster", F.split_part("key", F.lit(":"), F.lit(1)))
    place = F.row_number().over(W.partitionBy("repo", "cluster").orderBy(F.desc("score"), "key")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def plan(pages: DataFrame, most: int = PLAN_MOST) -> DataFrame:
    """(repo, place, slug, parent, title) of pages(repo, pos, slug, title): slugs made of letters, digits and hyphens, the n-th
    of a slug ending in ``-n``, ``index`` first (the first page if none is), all others below it, ``most`` in all."""
    clean = F.lower(F.trim("slug"))
    made = F.regexp_replace(F.regexp_replace(clean, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.when(clean.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), clean).when(made == "", "page").otherwise(made)
    rows = pages.select("repo", "pos", "title", slug.alias("slug"))
    n = F.row_number().over(W.partitionBy("repo", "slug").orderBy("pos"))
    rows = rows.withColumn("slug", F.when(n > 1, F.concat_ws("-", "slug", n.cast("string"))).otherwise(F.col("slug")))
    has = F.max((F.col("slug") == "index").cast("int")).over(W.partitionBy("repo"))
    first = F.row_number().over(W.partitionBy("repo").orderBy("pos"))
    rows = rows.withColumns({"_has": has, "_first": first}).withColumn("slug", F.when((F.col("_has") == 0) & (F.col("_first") == 1), "index").otherwise(F.col("slug")))
    place = F.row_number().over(W.partitionBy("repo").orderBy(F.col("slug") != "index", "pos")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= most).select("repo", "place", "slug", F.when(F.col("slug") != "index", "index").alias("parent"), "title")


# ---- Evidence -----------------------------------------------------------------------------------------------------


def evidence_pack(evidence: DataFrame, budget: int) -> DataFrame:
    """evidence(page, pos, kind, id, text): the first of each kind and id, in order while their characters fit the budget."""
    first = P.first_per_group(evidence.withColumn("_k", F.struct("page", "kind", "id")), "_k", "pos").drop("_k")
    return P.budgeted(first, "page", "pos", "text", budget)


# Bounds of a packed ledger.
PACK_RECORDS, PACK_CHARS, PACK_SNIPPET = 40, 4 * 3000 + 3, 320


def ledger(evidence: DataFrame) -> DataFrame:
    """evidence(page, pos, record_id, source, qn, file_path, start_line, end_line, snippet) without the records that a page
    has had before: the first of each record_id stays."""
    return P.first_per_group(evidence.withColumn("_k", F.struct("page", "record_id")), "_k", "pos").drop("_k")


def verified(records: DataFrame) -> DataFrame:
    """(page, kind, target) that the records of a ledger prove: names of code nodes, paths of files and of documents."""
    kind = F.when(F.col("source") == "code_node", "node").when(F.col("source").isin("file", "doc"), F.col("source"))
    target = F.when(kind == "node", F.col("qn")).otherwise(F.col("file_path"))
    return records.select("page", kind.alias("kind"), target.alias("target")).where("kind IS NOT NULL AND target != ''").distinct()


def packed(records: DataFrame, most: int = PACK_RECORDS, chars: int = PACK_CHARS) -> DataFrame:
    """(page, pack, n_earlier, n_cut): each page's last ``most`` records as blocks in their order, while these have ``chars`` characters
    at most, and how many came before them or didn't fit; both counts are told at the end of the pack."""
    source, unknown = F.col("source"), F.lit("<unknown>")
    name = F.when(source == "code_node", F.concat(F.lit("node:"), F.coalesce(F.nullif("qn", F.lit("")), unknown))).otherwise(F.concat(F.when(source == "doc", "doc:").otherwise("file:"), F.coalesce(F.nullif("file_path", F.lit("")), unknown)))
    place = F.concat(F.lit("\n  file: "), "file_path", F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.concat(F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))).otherwise(""))
    text = F.regexp_replace(F.coalesce("snippet", F.lit("")), r"^\s+|\s+$", "")
    text = F.when(F.length(text) > PACK_SNIPPET, F.concat(F.substring(text, 1, PACK_SNIPPET), F.lit("…"))).otherwise(text)
    text = F.when(text != "", F.concat(F.lit("\n  snippet: "), F.regexp_replace(text, "\r\n|[\n\r]", "\n    "))).otherwise("")
    block = F.concat(F.lit("["), "record_id", F.lit("] "), name, F.when((source == "code_node") & (F.coalesce("file_path", F.lit("")) != ""), place).otherwise(""), text)
    last = F.row_number().over(W.partitionBy("page").orderBy(F.desc("pos")))
    rows = records.withColumns({"last": last, "block": block})
    kept = rows.where(F.col("last") <= most)
    used = F.sum(F.length("block").cast("long") + 2).over(W.partitionBy("page").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    fits = kept.withColumn("used", used).where(F.col("used") <= chars)
    whole = rows.groupBy("page").agg(F.count("*").alias("n"))
    told = fits.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n").alias("body"), F.count("*").alias("n_in"))  # ``most`` blocks
    n_earlier, n_in = F.greatest(F.col("n") - most, F.lit(0)), F.coalesce("n_in", F.lit(0))
    n_cut = F.least("n", F.lit(most)) - n_in
    tail = F.concat_ws("\n", F.when(n_earlier > 0, F.concat(F.lit("... ["), n_earlier.cast("string"), F.lit(" earlier records elided]"))), F.when(n_cut > 0, F.concat(F.lit("... ["), n_cut.cast("string"), F.lit(" more records truncated for budget]"))))
    pack = F.concat(F.coalesce("body", F.lit("")), F.when(tail != "", F.concat(F.lit("\n\n"), tail)).otherwise(""))
    return whole.join(told, "page", "left").select("page", pack.alias("pack"), n_earlier.alias("n_earlier"), n_cut.alias("n_cut"))


def stripped(docs: DataFrame, verified: DataFrame) -> DataFrame:
    """(page, text, removed) of docs(page, text): placeholders that verified(page, kind, target) lacks are taken out."""
    from lodestone.operators.documents import citations

    bad = citations(docs, "page", "text").join(verified.select("page", "kind", "target").distinct(), ["page", "kind", "target"], "left_anti")
    marks = bad.groupBy("page").agg(F.array_sort(F.collect_set(F.concat(F.lit("[["), "kind", F.lit(":"), "target", F.lit("]]")))).alias("marks"))
    gone = F.aggregate(F.coalesce("marks", F.array().cast("array<string>")), F.col("text"), lambda t, m: F.replace(t, m, F.lit("")))
    return docs.join(marks, "page", "left").select("page", gone.alias("text"), F.coalesce(F.size("marks"), F.lit(0)).alias("removed"))


def coverage(docs: DataFrame, required: DataFrame, verified: DataFrame) -> DataFrame:
    """(page, answered, missing, ungrounded, extra) of docs(page, text), lists of questions in order.

    A comment ``<!-- answers: question -->`` stands for the text from it to the next second heading; it is grounded if that text
    has a placeholder, or a ``Source:`` line with a file, that verified(page, kind, target) has. required(page, question).
    Texts are read once, where they lie. All that is shuffled goes by page: the marks of its texts with what they cite, what was verified of
    it, and its questions.
    """
    from lodestone.operators.documents import cited

    parts = F.split("text", r"(?m)^(?=## )")
    begun = lambda p, s: F.transform(p, lambda x, k: F.struct(s.alias("s"), k.alias("k"), F.regexp_extract(x, r"^<!-- answers: ([\w-]+) -->", 1).alias("question"), F.array_join(F.slice(p, k + 1, F.size(p)), "").alias("text")))
    pieces = F.transform(parts, lambda part: F.split(part, r"(?=<!-- answers: )"))  # by itself, so that each part is split once
    begun_in = F.flatten(F.transform(pieces, begun))
    told = lambda m: F.array_union(cited(m["text"]), F.transform(F.regexp_extract_all(m["text"], F.lit(r"(?m)^Source: \[?([^\s\]():]+)"), F.lit(1)), lambda t: F.struct(F.lit("file").alias("kind"), t.alias("target"))))
    marks = docs.select("page", F.when(F.col("page").isNotNull(), F.filter(begun_in, lambda m: m["question"] != "")).alias("begun"))
    marks = marks.select("page", F.transform("begun", lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["question"].alias("question"), told(m).alias("told"))).alias("marks"))
    known = verified.groupBy("page").agg(F.collect_set(F.struct("kind", "target")).alias("known"))
    asked = required.groupBy("page").agg(F.collect_set("question").alias("asked"))
    found = F.transform("marks", lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["question"].alias("question"), F.coalesce(F.arrays_overlap(m["told"], F.col("known")), F.lit(False)).alias("good")))
    each = marks.join(known, "page", "left").select("page", F.inline_outer(found))
    each = each.groupBy("page", "s", "k", "question").agg(F.bool_or("good").alias("good")).groupBy("page", "question").agg(F.bool_or("good").alias("good"), F.bool_and("good").alias("always"))
    names = lambda c: F.collect_set(F.when(c, F.col("question")))
    out = each.groupBy("page").agg(F.collect_set("question").alias("here"), names(F.col("good")).alias("good"), names(~F.col("always")).alias("ungrounded")).join(asked, "page", "left")
    asked = F.coalesce("asked", F.array().cast("array<string>"))
    sets = {"answered": F.array_intersect("good", asked), "missing": F.array_except(asked, F.col("good")), "ungrounded": F.col("ungrounded"), "extra": F.array_except(F.col("here"), asked)}
    return out.select("page", *(F.array_sort(c).alias(n) for n, c in sets.items()))


# Second headings that a page must not have, the worst first, and how a page with one is called.
FORBIDDEN = ("open questions", "test strategy", "comparison with alternatives")
OUTCOMES = ("open_questions_forbidden", "test_strategy_forbidden", "comparison_forbidden")


def coverage_outcome(text: Column, missing: Column) -> Column:
    """What a page's coverage comes to: a forbidden section before all, the worst of several; then partial if questions are
    missing; else ok."""
    out = F.when(F.size(missing) > 0, "partial").otherwise("ok")
    for heading, name in reversed(tuple(zip(FORBIDDEN, OUTCOMES, strict=True))):
        out = F.when(F.coalesce(text, F.lit("")).rlike(rf"(?im)^## +{re.escape(heading)}[ \t]*$"), name).otherwise(out)
    return out


def without_markers(text: Column, questions: Column) -> Column:
    """text without the answer markers of these questions; what they stood for stays."""
    return F.aggregate(questions, text, lambda t, q: F.regexp_replace(t, F.concat(F.lit(r"<!-- answers: \Q"), q, F.lit(r"\E -->")), F.lit("")))


def without_sections(text: Column, headings: tuple[str, ...] = FORBIDDEN) -> Column:
    """text without the sections of these second headings."""
    return F.regexp_replace(text, r"(?msi)^## +(?:" + "|".join(re.escape(h) for h in headings) + r")[ \t]*$.*?(?=^## |\z)", "")


def edit_allowed(reason: Column, has_source: Column, is_index: Column, streak: Column, dead: Column, changed: Column, known: Column, most_churn: float = 0.5, most_streak: int = 3) -> Column:
    """Whether a dirty page may be edited in place: its cited nodes went or changed, it has a source and is not the index, few edits
    came before, and at most half of the names that it had are gone or changed."""
    churn = (dead + changed) / F.greatest(known, F.lit(1))
    return reason.isin("cited_node_content_changed", "cited_node_missing", "cited_chunk_missing", "cited_evidence_changed") & has_source & ~is_index & (streak < most_streak) & (churn <= most_churn)


def manifest_lines(facts: DataFrame, pages: DataFrame, caps: dict[str, int] | None = None, most: int = 18) -> DataFrame:
    """(page, place, line): of facts(kind, label, path, line) the first of each kind that pages(page, kind) covers.

    Kinds come in the order of ``caps``, which says how many of each there may be.
    """
    caps = caps or {"api": 8, "dependency": 6, "run_command": 4, "config_key": 6}
    order = V.literal_map({k: f"{n:02d}" for n, k in enumerate(caps)})
    cap = V.literal_map({k: str(v) for k, v in caps.items()})
    short = facts.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("path", "line", "label"))).where(F.col("_n") <= cap[F.col("kind")].cast("int"))
    rows = pages.select("page", "kind").distinct().join(F.broadcast(short), "kind")
    place = F.row_number().over(W.partitionBy("page").orderBy(order[F.col("kind")], "_n")).cast("long")
    line = F.concat(F.lit("["), "kind", F.lit("] "), "label", F.lit(" ("), "path", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    return rows.select("page", place.alias("place"), line.alias("line")).where(F.col("place") <= most)


def types_of_page(types: DataFrame, wanted: DataFrame, index_pages: DataFrame, most: int = 6) -> DataFrame:
    """(page, place, qualified_name): exported types(pos, qualified_name) that a page needs.

    First those that a chunk names, then those hinted at, then owners of names in chunks; for index_pages(page) without
    any, the first types. wanted(page, source, qualified_name); source is chunk or hint.
    """
    exact = wanted.join(types, "qualified_name").select("page", "qualified_name", "pos", F.when(F.col("source") == "chunk", 0).otherwise(1).alias("way"))
    parts = F.split("qualified_name", r"\.")
    owners = wanted.where("source = 'chunk'").select("page", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("qualified_name"))
    every = exact.unionByName(owners.join(types, "qualified_name").select("page", "qualified_name", "pos", F.lit(2).alias("way")))
    bare = index_pages.join(every.select("page").distinct(), "page", "left_anti").withColumn("way", F.lit(3))
    head = types.orderBy("pos").limit(most).withColumn("way", F.lit(3))
    every = every.unionByName(bare.join(F.broadcast(head), "way").select("page", "qualified_name", "pos", "way"))
    best = every.groupBy("page", "qualified_name").agg(F.min(F.struct("way", "pos")).alias("b"))
    place = F.row_number().over(W.partitionBy("page").orderBy("b.way", "b.pos")).cast("long")
    return best.select("page", place.alias("place"), "qualified_name").where(F.col("place") <= most)


def snapshot(files: DataFrame, summaries: DataFrame, docs: DataFrame, readmes: DataFrame) -> DataFrame:
    """(repo, part, place, value): what a page's author sees of a repository: 300 files by path, the 30 most important
    summaries, 30 documents, and 8,000 characters of the README."""
    def part(rows: DataFrame, name: str, value: str, most: int, *order) -> DataFrame:
        place = F.row_number().over(W.partitionBy("repo").orderBy(*order)).cast("long")
        return rows.select("repo", F.lit(name).alias("part"), place.alias("place"), F.col(value).alias("value")).where(F.col("place") <= most)

    return (
        part(files, "file", "path", 300, "path").unionByName(part(summaries, "summary", "summary", 30, F.desc("importance"), "id"))
        .unionByName(part(docs, "doc", "path", 30, "path")).unionByName(part(readmes.withColumn("readme", F.substring("readme", 1, 8000)), "readme", "readme", 1, "readme"))
    )


def summary_actions(nodes: DataFrame, summaries: DataFrame, top: DataFrame, model: str) -> DataFrame:
    """(id, action): generate a top node whose hashes or model differ from its summary's (or that has none), skip the others,
    prune summaries of nodes outside the top. nodes(id, content_hash, neighbour_hash); pruning is for after generation."""
    old = summaries.select("id", F.col("content_hash").alias("_c"), F.col("neighbour_hash").alias("_n"), F.col("model").alias("_m"))
    rows = nodes.join(top.select("id"), "id", "left_semi").join(old, "id", "left")
    same = F.col("content_hash").eqNullSafe(F.col("_c")) & F.col("neighbour_hash").eqNullSafe(F.col("_n")) & F.col("_m").eqNullSafe(F.lit(model))
    kept = rows.select("id", F.when(same, "skip").otherwise("generate").alias("action"))
    return kept.unionByName(summaries.join(top.select("id"), "id", "left_anti").select("id", F.lit("prune").alias("action")))


def plan_health(pages: DataFrame) -> DataFrame:
    """(repo, collapse, churn) of pages(repo, collapsed, changed): the shares that lost all they cite, and that changed; 1 and 0 of no pages."""
    n = F.count_if(F.col("page").isNotNull())
    return pages.groupBy("repo").agg(F.coalesce(F.try_divide(F.count_if("collapsed"), n), F.lit(1.0)).alias("collapse"), F.coalesce(F.try_divide(F.count_if("changed"), n), F.lit(0.0)).alias("churn"))


def page_quality(pages: DataFrame, cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page, node_citations, doc_citations, unresolved, low_confidence, has_diagram) of pages(page, rendered).

    cited(page, kind, ref): ref is null if unresolved; chunks(page, score).
    """
    of = cited.groupBy("page").agg(*(F.count_if((F.col("kind") == k) & F.col("ref").isNotNull()).alias(f"{k}_citations") for k in ("node", "doc")), F.count_if(F.col("ref").isNull()).alias("unresolved"))
    low = chunks.groupBy("page").agg(F.count_if(F.col("score") < LOW_CONFIDENCE).alias("low_confidence"))
    out = pages.select("page", F.coalesce(F.col("rendered").contains("```mermaid"), F.lit(False)).alias("has_diagram")).join(of, "page", "left").join(low, "page", "left")
    return out.na.fill(0, ["node_citations", "doc_citations", "unresolved", "low_confidence"])


# ---- Links --------------------------------------------------------------------------------------------------------


def _safe_text(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)" + UNTOUCHED, "\n")


def _rewritten(rows: DataFrame, rewrite, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([rewrite(*r) for r in zip(*(b[c] for c in columns), strict=True)], columns=[x.split()[0] for x in schema.split(", ")])

    return rows.select(*columns).mapInPandas(run, schema)


def auto_linked(docs: DataFrame, nodes: DataFrame, sources: DataFrame, most: int = AUTO_LINKS) -> DataFrame:
    """(page, text, n_links) of docs(page, text): names of nodes become ``[[node:name]]``.

    Dotted names, in backticks or bare, must be a node's qualified name; single words in backticks the name of one of the
    page's own nodes, sources(page, id), and of one qualified name only. Fences, links and placeholders are left alone.
    A page is sent with the names that it can use, no more.
    """
    ticked = F.regexp_extract_all("safe", F.lit(BACKTICKED), F.lit(1))
    bare = F.regexp_extract_all("safe", F.lit(DOTTED), F.lit(0))
    clean = F.transform(ticked, lambda t: F.trim(F.regexp_replace(F.trim(t), r"^[*&]+", "")))
    asked = docs.select("page", _safe_text(F.col("text")).alias("safe")).select("page", F.explode(F.array_distinct(F.concat(clean, bare))).alias("word"))
    full = asked.join(nodes.select(F.col("qualified_name").alias("word")).distinct(), "word").where(F.col("word").contains(".")).select("page", "word", F.col("word").alias("target"))
    own = sources.join(nodes.select("id", F.col("name").alias("word"), F.col("qualified_name").alias("target")), "id").select("page", "word", "target").distinct()
    own = own.groupBy("page", "word").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    single = asked.where(~F.col("word").contains(".") & ~F.col("word").isin(*NEVER_LINKED)).join(own, ["page", "word"])
    names = full.unionByName(single).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "target"))).alias("names"))
    rows = docs.join(names, "page", "left").select("page", "text", F.to_json("names").alias("names"))
    return _rewritten(rows, lambda page, text, names: (page, *link_names(text, names, most)), ["page", "text", "names"], f"page {docs.schema['page'].dataType.simpleString()}, text string, n_links long")


def link_names(text: str | None, names: str | None, most: int) -> tuple[str | None, int]:
    """text with the given names, a JSON map, linked outside fences, links and placeholders; and how many were."""
    import json

    if not text or not names:
        return text, 0
    known, done = json.loads(names), 0

    def to_link(match: re.Match[str], word: str) -> str:
        nonlocal done
        if done >= most or word not in known:
            return match[0]
        done += 1
        return f"[[node:{known[word]}]]"

    def outside(pattern: str, part: str) -> str:
        out, at = [], 0
        for m in re.finditer(UNTOUCHED, part, re.DOTALL):
            out += [re.sub(pattern, one, part[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, re.sub(pattern, one, part[at:])])

    for pattern in (BACKTICKED, DOTTED):  # placeholders of the first pass are left alone by the second
        ticks = pattern is BACKTICKED
        one = lambda m, ticks=ticks: to_link(m, re.sub(r"^[*&]+", "", m[1].strip()).strip() if ticks else m[0])
        text = outside(pattern, text)
    return text, done


def sane_links(docs: DataFrame, slugs: DataFrame, tracked: DataFrame, repo: str) -> DataFrame:
    """(page, text) of docs(page, text) without links that lead nowhere.

    Bullets that are only a link to an unknown page go; other such links, raw graph links and raw links to untracked files
    of the repository become their label; raw links to tracked files, tracked(path, slug), get the slug; line ranges
    become plain text. A page is sent with those slugs and files that it mentions.
    """
    links = docs.select("page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)))).alias("url"))
    near = links.withColumn("slug", F.nullif(F.regexp_extract("url", f"^{SIBLING}$", 1), F.lit(""))).join(slugs.select("slug").distinct(), "slug").groupBy("page").agg(F.collect_set("slug").alias("slugs"))
    path = F.split_part(F.regexp_extract("url", f"^{RAW_DOCS}$", 2), F.lit("#"), F.lit(1))
    files = links.withColumn("path", path).join(tracked.select("path", "slug"), "path").groupBy("page").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "slug")))).alias("files"))
    rows = docs.join(near, "page", "left").join(files, "page", "left").select("page", "text", F.array_join(F.coalesce("slugs", F.array().cast("array<string>")), "\n").alias("slugs"), "files")
    return _rewritten(rows, lambda page, text, slugs, files: (page, sane_text(text, set(slugs.split("\n")), files, repo)), ["page", "text", "slugs", "files"], f"page {docs.schema['page'].dataType.simpleString()}, text string")


def sane_text(text: str | None, slugs: set[str], files: str | None, repo: str) -> str | None:
    import json

    if not text:
        return text
    tracked = json.loads(files) if files else {}
    lines = [x for x in text.splitlines(keepends=True) if not (m := re.fullmatch(SIBLING_BULLET, x.rstrip("\r\n"))) or m[1] in slugs]

    def fixed(m: re.Match[str]) -> str:
        label, url = m[1], m[2]
        if re.fullmatch(LINE_RANGE, url):
            return f"{label}:{url}"
        if near := re.fullmatch(SIBLING, url):
            return m[0] if near[1] in slugs else label
        raw = re.fullmatch(RAW_DOCS, url)
        if raw and raw[1] == repo:
            path, mark, fragment = raw[2].partition("#")
            if "/" not in path and "." not in path:
                return m[0]
            return f"[{label}](/repos/{repo}/docs/{tracked[path]}{mark if fragment else ''}{fragment})" if path in tracked else label
        graph = re.fullmatch(RAW_GRAPH, url)
        return label if graph and graph[1] == repo else m[0]

    return re.sub(MARKDOWN_LINK, fixed, "".join(lines))
