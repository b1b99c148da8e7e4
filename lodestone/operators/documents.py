"""Document trees, citations, leads, manifests and the small tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T

PINNED = ("readme", "index", "overview")


def docs_tree(docs: DataFrame) -> DataFrame:
    """(path, parent, is_dir, sort_order) of docs(path) and all their directories: pinned files
    first, then directories, then the rest, by name."""
    parts = F.split("path", "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), lambda p: p != F.col("path"))
    dirs = docs.select(F.explode(above).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    every = docs.select("path").distinct().withColumn("is_dir", F.lit(False)).unionByName(dirs)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    group = F.when(~F.col("is_dir") & stem.isin(*PINNED), 0).when(F.col("is_dir"), 1).otherwise(2)
    order = F.row_number().over(W.partitionBy("parent").orderBy("group", F.lower("path"), "path")) - 1
    return every.withColumns({"parent": parent, "group": group}).select("path", "parent", "is_dir", order.cast("long").alias("sort_order"))


def slugs(docs: DataFrame, id: str, path: str) -> DataFrame:
    """(id, slug): equal slugs get the last four characters of the id, all but the first by path."""
    named = docs.select(id, path, T.slug(F.col(path)).alias("slug"))
    n = F.row_number().over(W.partitionBy("slug").orderBy(path, id))
    return named.withColumn("_n", n).select(id, F.when(F.col("_n") > 1, F.concat_ws("-", "slug", F.substring(F.col(id).cast("string"), -4, 4))).otherwise(F.col("slug")).alias("slug"))


def page_tree(pages: DataFrame, slug: str, parent: str) -> DataFrame:
    """pages with ``parent`` cleared where no page has that slug, or where it is the page itself."""
    known = pages.select(F.col(slug).alias(parent)).distinct().withColumn("_known", F.lit(True))
    joined = pages.join(known, parent, "left")
    return joined.withColumn(parent, F.when(F.col("_known") & (F.col(parent) != F.col(slug)), F.col(parent))).drop("_known").select(*pages.columns)


def cited(text: Column) -> Column:
    """Array of (kind, target): ``[[node:name]]`` and ``[[doc:path#heading]]``, each once."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[((?:node|doc):[^\]]+)\]\]"), F.lit(1))
    return F.transform(F.array_distinct(raw), lambda x: F.struct(F.regexp_extract(x, "^(node|doc):", 1).alias("kind"), F.trim(F.regexp_replace(x, "^(node|doc):", "")).alias("target")))


def citations(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, kind, target) of ``cited``."""
    return docs.select(id, F.inline(cited(F.col(text))))


def resolve_citations(cited: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """cited with ``ref``: the node of that qualified name, or the document of that path (its heading aside); null if unresolved."""
    targets = nodes.select(F.lit("node").alias("kind"), F.col("qualified_name").alias("_key"), F.col("id").cast("string").alias("ref"))
    targets = targets.unionByName(docs.select(F.lit("doc").alias("kind"), F.col("path").alias("_key"), F.col("id").cast("string").alias("ref")))
    targets = targets.groupBy("kind", "_key").agg(F.min("ref").alias("ref"))
    return cited.withColumn("_key", F.split_part("target", F.lit("#"), F.lit(1))).join(targets, ["kind", "_key"], "left").drop("_key")


def repair(cited: DataFrame, old: DataFrame, live: DataFrame) -> DataFrame:
    """cited(page, node_id) with ``new_id``: itself if alive, else the live node of the name it had, else null."""
    alive = live.select(F.col("id").alias("node_id"), F.lit(True).alias("_alive"))
    names = old.select(F.col("id").alias("node_id"), "qualified_name")
    by_name = live.groupBy("qualified_name").agg(F.min("id").alias("_by_name"))
    out = cited.join(alive, "node_id", "left").join(names, "node_id", "left").join(by_name, "qualified_name", "left")
    return out.select("page", "node_id", F.when(F.col("_alive"), F.col("node_id")).otherwise(F.col("_by_name")).alias("new_id"))


def lead(text: Column, chars: int = 400, sections: int = 3) -> Column:
    """Opening prose: the body up to the section after ``sections`` H2, without headings, fences, links'
    targets and source lines, whitespace collapsed, cut at a word."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?ms)^\s*(```|~~~).*?^\s*\1[^\n]*$", "")
    out = F.substring_index(F.concat(F.lit("\n"), out), "\n## ", sections + 1)
    for pattern, by in ((r"(?m)^#{1,6}\s.*$", ""), (r"(?im)^\W*sources?:.*$", ""), (r"(?s)<!--.*?-->", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1")):
        out = F.regexp_replace(out, pattern, by)
    out = T.collapse(out)
    return F.when(F.length(out) <= chars, out).otherwise(F.concat(F.rtrim(F.regexp_replace(F.substring(out, 1, chars), r"\s+\S*$", "")), F.lit("…")))


# What declares a dependency or a runtime in a manifest of a kind.
MANIFESTS = {
    "requirements.txt": (("dependency", r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:[=<>!~\[;].*)?$"),),
    "go.mod": (("dependency", r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v\S+"), ("runtime", r"(?m)^go\s+(\S+)")),
    "package.json": (("dependency", r'"((?:@[\w.-]+/)?[\w.-]+)"\s*:\s*"[\^~]?\d[^"]*"'), ("runtime", r'"node"\s*:\s*"([^"]+)"')),
    "Dockerfile": (("runtime", r"(?m)^FROM\s+(\S+)"), ("run_command", r"(?m)^CMD\s+(.+)$"), ("config_key", r"(?m)^ENV\s+([A-Z_][A-Z0-9_]*)")),
    ".env.example": (("config_key", r"(?m)^([A-Z_][A-Z0-9_]*)\s*="),),
    "Makefile": (("run_command", r"(?m)^([a-z][\w-]*):"),),
}


def manifest_facts(files: DataFrame, most: int = 30) -> DataFrame:
    """(kind, value, path, line): facts of files(path, content), the first place of each, ``most`` of a kind."""
    name = F.element_at(F.split("path", "/"), -1)
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    rules = None
    for file, own in MANIFESTS.items():
        found = [F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), named(kind)) for kind, pattern in own]
        rules = (F.when if rules is None else rules.when)(F.col("name") == file, F.concat(*found))
    lines = files.where(name.isin(*MANIFESTS)).select("path", name.alias("name"), F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    out = lines.select("path", (F.col("pos") + 1).cast("long").alias("line"), F.explode(rules).alias("f")).select("f.kind", "f.value", "path", "line")
    # A value of very many files is summed up before it is shuffled; a window would sort all of its places in one task.
    first = out.groupBy("kind", "value").agg(F.min(F.struct("path", "line")).alias("at")).select("kind", "value", "at.path", "at.line")
    return first.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy("path", "line", "value"))).where(F.col("_n") <= most).drop("_n")


# Files whose usage section tells what a project is for.
USAGE_FILES = ("README.md", "readme.md", "Readme.md", "README.MD")
USAGE_HEADING = r"(?im)^#{1,6}\s+(usage|examples?|quick\s?start|getting started)\b[^\n]*$"


def use_cases(files: DataFrame, most: int = 30) -> DataFrame:
    """(repo, label, path, line, snippet) of files(repo, path, content): the usage section of the first README that has one, up to
    the next heading or 800 characters, then what the examples folder holds, by name."""
    readme = files.withColumn("_n", F.array_position(F.array(*map(F.lit, USAGE_FILES)), F.col("path"))).where("_n > 0")
    before = F.regexp_extract("content", r"(?s)\A(.*?)(?=" + USAGE_HEADING + ")", 1)
    found = readme.where(F.col("content").rlike(USAGE_HEADING)).withColumn("before", before)
    rest = F.substring("content", F.length("before") + 1, F.length("content"))
    section = F.substring(F.regexp_extract(rest, r"(?s)\A([^\n]*(?:\n(?!#+\s+\S)[^\n]*)*)", 1), 1, 800)
    label = F.initcap(F.regexp_extract(rest, USAGE_HEADING, 1))
    line = (F.length("before") - F.length(F.replace("before", F.lit("\n"), F.lit(""))) + 1).cast("long")
    first = found.withColumn("_k", F.row_number().over(W.partitionBy("repo").orderBy("_n"))).where("_k = 1")
    told = first.select("repo", label.alias("label"), "path", line.alias("line"), section.alias("snippet"), F.lit(0).alias("_part"))
    entry = F.split_part("path", F.lit("/"), F.lit(2))
    inner = files.where(F.col("path").startswith("examples/") & ~entry.startswith(".")).groupBy("repo", entry.alias("e")).agg(F.max(F.size(F.split("path", "/"))).alias("deep"))
    held = inner.select("repo", F.concat(F.lit("examples/"), "e").alias("label"), F.concat(F.lit("examples/"), "e").alias("path"), F.lit(None).cast("long").alias("line"), F.when(F.col("deep") > 2, F.concat(F.lit("directory examples/"), "e", F.lit("/"))).otherwise(F.col("e")).alias("snippet"), F.lit(1).alias("_part"))
    place = F.row_number().over(W.partitionBy("repo").orderBy("_part", "label"))
    return told.unionByName(held).withColumn("_k", place).where(F.col("_k") <= most).drop("_part", "_k")


def error_types(nodes: DataFrame, most: int = 30) -> DataFrame:
    """The first exported types, by qualified name, that are errors by their name or what they extend: Go structs, Python,
    TypeScript and JavaScript classes. nodes(qualified_name, name, node_type, language, bases)."""
    ends = lambda c, *e: F.array_contains(F.transform(F.array(*map(F.lit, e)), lambda x: c.endswith(x)), True)
    last = lambda b: F.element_at(F.split(b, r"\."), -1)
    bases, n, cls = F.coalesce("bases", F.array().cast("array<string>")), F.col("name"), F.col("node_type") == "class"
    is_error = (
        F.when(F.col("language") == "go", (F.col("node_type") == "struct") & n.endswith("Error") & (n != "Error"))
        .when(F.col("language") == "python", cls & (ends(n, "Error", "Exception") | F.exists(bases, lambda b: ends(last(b), "Error", "Exception"))))
        .when(F.col("language").isin("typescript", "javascript"), cls & ((ends(n, "Error", "Exception") & (n != "Error")) | F.exists(bases, lambda b: last(b).endswith("Error"))))
        .otherwise(False)
    )
    return nodes.where(is_error & exported(F.col("language"), n)).orderBy("qualified_name").limit(most)


READ_LINES, READ_BYTES, LISTED = 400, 20_000, 200


def read_text(files: DataFrame, offset: int = 0, limit: int = READ_LINES) -> DataFrame:
    """(path, body, truncated) of files(path, content): lines from ``offset``, READ_LINES and READ_BYTES at most; files with a NUL character are left out."""
    rows = files.where(~F.col("content").contains("\x00")).withColumn("_l", F.split("content", "\n"))
    want = max(1, min(limit, READ_LINES))
    body = F.array_join(F.slice("_l", max(0, offset) + 1, want), "\n")
    text, cut = T.utf8_cap(F.col("_b"), READ_BYTES)
    return rows.withColumn("_b", body).select("path", text.alias("body"), (cut | (F.size("_l") > max(0, offset) + want)).alias("truncated"))


def list_files(files: DataFrame, pattern: str = ".*", most: int = LISTED) -> DataFrame:
    """The first paths, in order, that a regular expression matches as a whole."""
    return files.where(F.col("path").rlike(f"^(?:{pattern})$")).select("path").orderBy("path").limit(most)


def exported(language: Column, name: Column) -> Column:
    """Visible outside its file or package: Go by an upper-case letter, others without a leading underscore."""
    return F.when(language == "go", name.rlike("^[A-Z]")).otherwise(~name.startswith("_"))


def public_types(nodes: DataFrame, fields: int = 12, methods: int = 8) -> DataFrame:
    """(id, name, fields, methods): exported types with their first exported members."""
    types = nodes.where(F.col("node_type").isin("class", "struct", "interface", "type_alias") & exported(F.col("language"), F.col("name")))
    children = nodes.where(F.col("node_type").isin("attribute", "method") & exported(F.col("language"), F.col("name"))).select(F.col("parent_id").alias("id"), F.col("name").alias("member"), "node_type", "start_line")
    place = F.row_number().over(W.partitionBy("id", "node_type").orderBy("start_line", "member"))
    kept = children.withColumn("_n", place).where(F.col("_n") <= F.when(F.col("node_type") == "method", methods).otherwise(fields))
    names = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("node_type") == t, F.struct("_n", "member")))), lambda s: s["member"])
    lists = kept.groupBy("id").agg(names("attribute").alias("fields"), names("method").alias("methods"))
    none = F.array().cast("array<string>")
    return types.select("id", "name").join(lists, "id", "left").withColumns({"fields": F.coalesce("fields", none), "methods": F.coalesce("methods", none)})


def pivot(hits: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(id, callers, callees, parent) of the first ``most`` different hits(pos, id), ids sorted."""
    chosen = hits.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos").limit(most).select("id")
    near = lambda at, other, name: edges.join(F.broadcast(chosen.withColumnRenamed("id", at)), at).groupBy(F.col(at).alias("id")).agg(F.array_sort(F.collect_set(other)).alias(name))
    out = chosen.join(near("dst", "src", "callers"), "id", "left").join(near("src", "dst", "callees"), "id", "left")
    return out.join(nodes.select("id", F.col("parent_id").alias("parent")), "id", "left") if "parent_id" in nodes.columns else out


def existing(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids(pos, id) with ``known``, in the order given."""
    return ids.join(nodes.select("id").distinct().withColumn("known", F.lit(True)), "id", "left").select("pos", "id", F.coalesce("known", F.lit(False)).alias("known"))


def grep(files: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """(path, line, text) of lines that match, the first ``most`` by path and line; binary files are skipped."""
    rows = files.where(~F.col("content").contains("\x00")).select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return rows.where(F.col("text").rlike(pattern)).select("path", (F.col("pos") + 1).cast("long").alias("line"), "text").orderBy("path", "line").limit(most)


def byte_range(raw: Column, start: Column, end: Column) -> Column:
    """Text of bytes [start, end) of a binary column, null where that cuts a character."""
    cut = F.substring(raw, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    return F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string"))


def node_bodies(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with ``body``: the file's bytes of the node, else its stored content."""
    joined = nodes.join(files.select(F.col("path").alias("file_path"), F.col("content").alias("_raw")), "file_path", "left")
    return joined.withColumn("body", F.coalesce(byte_range(F.col("_raw"), F.col("start_byte"), F.col("end_byte")), "content")).drop("_raw")


def embed_status(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("total"), F.count(vector).alias("embedded")).withColumn("ready", (F.col("total") > 0) & (F.col("total") == F.col("embedded")))


def token_estimate(rows: DataFrame, text: str) -> DataFrame:
    return rows.agg(F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).alias("tokens"))


def memberships(rows: DataFrame) -> DataFrame:
    """One row for each user and group; synchronised ones win over manual ones."""
    first = F.row_number().over(W.partitionBy("user_id", "group_id").orderBy(F.when(F.col("source") == "oidc", 0).otherwise(1)))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def steering_pages(pages: DataFrame, most: int = 25) -> DataFrame:
    """Given pages(pos, title, parent) that are kept: titled, the first of a title, ``most`` of them; parents
    that are unknown, the page itself, or below another page are cleared."""
    titled = pages.where(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("_k", F.lower(F.trim("title")))
    kept = titled.withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy("pos"))).where("_n = 1").orderBy("pos").limit(most).drop("_n")
    tops = kept.where(F.col("parent").isNull()).select(F.col("_k").alias("_p")).withColumn("_top", F.lit(True))
    out = kept.withColumn("_p", F.lower(F.trim("parent"))).join(tops, "_p", "left")
    return out.select("pos", "title", F.when(F.col("_top") & (F.col("_p") != F.col("_k")), F.col("parent")).alias("parent"))
