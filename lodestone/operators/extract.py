"""Code and Markdown to rows: what only sequential parsing can do, batch by batch."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ranges import above, between, edges
from lodestone.sources.shared import stored

NODE = "file_path string, qualified_name string, name string, node_type string, parent string, start_line long, end_line long, signature string, content_hash string, decorators array<string>, bases array<string>, error string"
EDGE = "file_path string, source string, type string, target string"


def module_name(path: str) -> str:
    parts = re.sub(r"\.pyi?$", "", path).split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


class _Python(ast.NodeVisitor):
    """Definitions and references of one module."""

    def __init__(self, path: str, code: str):
        self.path, self.lines, self.module = path, code.split("\n"), module_name(path)
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.scope = [(self.module, "module")]
        self.add(self.module, "module", None, 1, len(self.lines), None)

    def add(self, name: str, kind: str, parent: str | None, first: int, last: int, signature: str | None, decorators=(), bases=()):
        body = "\n".join(self.lines[first - 1 : last])
        self.nodes.append((self.path, name, name.rpartition(".")[2], kind, parent, first, last, signature, hashlib.sha256(body.encode()).hexdigest(), list(decorators), list(bases), None))
        if parent:
            self.edges.append((self.path, parent, "declares", name))

    def define(self, node, kind: str, signature: str, bases=()):
        owner, _ = self.scope[-1]
        name = f"{owner}.{node.name}"
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.add(name, kind, owner, first, node.end_lineno, signature, [ast.unparse(d) for d in node.decorator_list], bases)
        self.scope.append((name, kind))
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_ClassDef(self, node):
        bases = [ast.unparse(b) for b in node.bases]
        self.edges += [(self.path, f"{self.scope[-1][0]}.{node.name}", "inherits", b) for b in bases]
        self.define(node, "class", f"class {node.name}({', '.join(bases)})", bases)

    def visit_FunctionDef(self, node):
        if self.scope[-1][1] in ("function", "method"):  # calls of a nested function belong to the outer one
            for child in node.body:
                self.visit(child)
            return
        self.define(node, "method" if self.scope[-1][1] == "class" else "function", f"def {node.name}({ast.unparse(node.args)})")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        self.edges += [(self.path, self.module, "imports", a.name + (f" as {a.asname}" if a.asname else "")) for a in node.names]

    def visit_ImportFrom(self, node):
        start = "." * node.level + (node.module or "")
        dot = "" if start.endswith(".") or not start else "."
        self.edges += [(self.path, self.module, "imports", start + dot + a.name + (f" as {a.asname}" if a.asname else "")) for a in node.names]

    def visit_Assign(self, node):
        for target in node.targets:
            if isinstance(target, ast.Name) and self.scope[-1][1] in ("module", "class"):
                kind = "attribute" if self.scope[-1][1] == "class" else "constant" if target.id.isupper() else "variable"
                self.add(f"{self.scope[-1][0]}.{target.id}", kind, self.scope[-1][0], node.lineno, node.end_lineno, None)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name) and self.scope[-1][1] in ("module", "class"):
            kind = "attribute" if self.scope[-1][1] == "class" else "constant" if node.target.id.isupper() else "variable"
            self.add(f"{self.scope[-1][0]}.{node.target.id}", kind, self.scope[-1][0], node.lineno, node.end_lineno, ast.unparse(node.annotation))
        self.generic_visit(node)

    def visit_TypeAlias(self, node):
        self.add(f"{self.scope[-1][0]}.{node.name.id}", "type_alias", self.scope[-1][0], node.lineno, node.end_lineno, ast.unparse(node.value))

    def visit_Call(self, node):
        try:
            target = ast.unparse(node.func)
        except ValueError:
            target = ""
        if re.fullmatch(r"[A-Za-z_][\w.]*", target):
            self.edges.append((self.path, self.scope[-1][0], "calls", target))
        self.generic_visit(node)


def parse_python(path: str, code: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges); a file that doesn't parse is one node with its error."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, module_name(path), module_name(path).rpartition(".")[2], "module", None, 1, code.count("\n") + 1, None, hashlib.sha256(code.encode()).hexdigest(), [], [], f"{type(e).__name__}: {e}")], []
    found = _Python(path, code)
    for child in tree.body:
        found.visit(child)
    return found.nodes, list(dict.fromkeys(found.edges))


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def python_nodes(files: DataFrame) -> DataFrame:
    """Nodes of files(path, content string)."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([n for p, c in zip(b["path"], b["content"], strict=True) for n in parse_python(p, c or "")[0]], columns=_columns(NODE))

    return files.select("path", "content").mapInPandas(parsed, NODE)


def python_edges(files: DataFrame) -> DataFrame:
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([e for p, c in zip(b["path"], b["content"], strict=True) for e in parse_python(p, c or "")[1]], columns=_columns(EDGE))

    return files.select("path", "content").mapInPandas(parsed, EDGE)


# Fixed values in this function: decorators, names and endings of each role, and the order of its rules.
def role(node_type: Column, name: Column, decorators: Column, bases: Column) -> Column:
    """What a node is for: by decorators, then by kind and name."""
    low = F.transform(F.coalesce(decorators, F.array().cast("array<string>")), lambda d: F.lower(F.regexp_replace(d, "^@+", "")))
    starts = lambda *p: F.exists(low, lambda d: d.rlike("^(" + "|".join(x.replace(".", r"\.") for x in p) + ")"))
    nest = lambda *p: F.exists(low, lambda d: F.split_part(d, F.lit("("), F.lit(1)).isin(*p))
    typed = node_type.isin("class", "struct", "interface")
    called = node_type.isin("function", "method")
    return (
        F.when(starts("app.", "router.", "blueprint.", "api.", "web."), "entry_point").when(starts("pytest.", "unittest."), "test")
        .when(nest("controller", "resolver"), "entry_point").when(nest("injectable"), "service")
        .when(node_type.isin("type_alias", "attribute", "constant"), node_type)
        .when((node_type == "variable") & name.isin("logger", "log", "tracer"), "helper")
        .when((node_type == "variable") & (name.isin("settings", "config") | name.endswith("_config")), "config")
        .when((node_type == "variable") & name.rlike("[A-Z]") & ~name.rlike("[a-z]"), "constant")
        .when(typed & name.endswith("Service"), "service").when(typed & name.rlike("(Repository|Dao|Repo)$"), "repository").when(typed & name.rlike("(Model|Entity|Schema)$"), "model")
        .when(typed & F.exists(F.coalesce(bases, F.array().cast("array<string>")), lambda b: b.contains("BaseModel") | b.contains("Schema")), "model")
        .when(typed & name.rlike("^Test|Test$"), "test")
        .when(called & name.rlike("^(test_|Test)|^test$"), "test").when(called & name.startswith("_"), "helper")
        .when((node_type == "module") & name.isin("config", "settings"), "config").when((node_type == "module") & name.rlike("^test_|^tests$"), "test")
        .otherwise("other")
    )


def attribution(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, first_sha, first_at, last_sha, last_at) of nodes(id, path, start_line, end_line): the oldest and newest commit that a
    line of each comes from, by hunks(path, first, count, sha, committed_at); nodes that no hunk touches are left out.

    Ranges are cut into buckets of 128 lines. In the first and the last bucket of a range, hunks of the same lines count once (128
    lines have 8,256 ranges) and meet nodes by their lines. The whole buckets between are dyadic cells; what lies in a cell, and what covers it, is
    summed up once for a path, on the levels that the other side has. Rows grow with the numbers of nodes and hunks, not with lines.
    """
    commit = F.struct("committed_at", "sha")
    first, last = F.col("first"), F.col("first") + F.col("count") - 1
    own = stored(hunks.where("count > 0").select("path", commit.alias("c"), edges(first, last).alias("edges"), between(first, last).alias("cells")), "blame-hunks")
    start, end = F.col("start_line"), F.col("end_line")
    asked = nodes.where("end_line >= start_line").select("id", "path", edges(start, end).alias("edges"), between(start, end).alias("cells"))
    edge = lambda rows, *more: rows.select("path", F.explode("edges").alias("e"), *more).select("path", "e.*", *more)
    lines = edge(own, "c").groupBy("path", "bucket", "low", "high").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    mine = edge(asked, "id").withColumnsRenamed({"low": "from", "high": "to"})
    out = mine.join(lines, ["path", "bucket"]).where("low <= to AND `from` <= high").select("id", "a", "b")
    for whole, parts, role in ((asked, own, "inside"), (own, asked, "covers")):
        levels = [r[0] for r in whole.where(F.size("cells") > 0).select(F.explode("cells.level")).distinct().collect()]  # 15 at most
        if not levels:
            continue
        every = F.concat("cells", F.transform("edges", lambda e: F.struct(F.lit(0).alias("level"), e["bucket"].alias("index"))))
        under = F.filter(F.concat(every, above(every)), lambda c: c["level"].isin(levels))
        side = lambda rows, found: rows.select("path", F.explode(found).alias("cell"), "c" if rows is own else "id")
        held, asks = (side(parts, under), side(whole, F.col("cells"))) if role == "inside" else (side(whole, F.col("cells")), side(parts, under))
        sums = held.groupBy("path", "cell").agg(F.min("c").alias("a"), F.max("c").alias("b"))
        out = out.union(asks.join(sums, ["path", "cell"]).select("id", "a", "b"))
    out = out.groupBy("id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return out.select("id", F.col("a.sha").alias("first_sha"), F.col("a.committed_at").alias("first_at"), F.col("b.sha").alias("last_sha"), F.col("b.committed_at").alias("last_at"))


_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def markdown_chunks(text: str, most: int = 4000, least: int = 400, most_chunks: int = 512) -> list[tuple[int, list[str], str]]:
    """(chunk_index, heading_path, content): sections by heading, packed up to ``most`` characters;
    fences and tables stay whole; a short tail joins the chunk before it."""
    parts: list[tuple[list[str], list[str]]] = []
    path: list[str] = []
    for line in text.splitlines():
        if m := _HEADING.match(line):
            path = path[: len(m[1]) - 1] + [m[2].strip()]
            parts.append((list(path), [line]))
        elif parts:
            parts[-1][1].append(line)
        else:
            parts.append(([], [line]))
    out: list[tuple[list[str], str]] = []
    held: list[tuple[list[str], list[str]]] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            shared = held[0][0]
            for p, _ in held[1:]:
                shared = [a for a, b in zip(shared, p, strict=False) if a == b][: next((k for k, (a, b) in enumerate(zip(shared, p, strict=False)) if a != b), min(len(shared), len(p)))]
            out.append((shared, "\n".join(x for _, rows in held for x in rows).strip()))
        held, size = [], 0

    for own, rows in parts:
        n = len("\n".join(rows))
        if n > most:
            flush()
            out += [(own, c) for c in _split_blocks(rows, most)]
            continue
        if held and size + n > most:
            flush()
        held.append((own, rows))
        size += n + 1
    if held and size < least and out and len(out[-1][1]) + size <= 2 * most:
        tail = "\n".join(x for _, rows in held for x in rows).strip()
        out[-1] = (out[-1][0], f"{out[-1][1]}\n{tail}".strip())
    else:
        flush()
    return [(k, p, c) for k, (p, c) in enumerate(out[:most_chunks])]


def _split_blocks(rows: list[str], most: int) -> list[str]:
    """Lines of a long section in pieces of up to ``most`` characters, fences and tables whole."""
    blocks: list[list[str]] = []
    fence = table = False
    for line in rows:
        edge = line.lstrip().startswith(("```", "~~~"))
        in_table = line.lstrip().startswith("|") and not fence
        if blocks and (fence or (table and in_table)):
            blocks[-1].append(line)
        else:
            blocks.append([line])
        fence ^= edge
        table = in_table
    out, held, size = [], [], 0
    for b in blocks:
        n = sum(len(x) + 1 for x in b)
        if held and size + n > most:
            out.append("\n".join(held).strip())
            held, size = [], 0
        held += b
        size += n
    return [x for x in [*out, "\n".join(held).strip()] if x]


def chunked(docs: DataFrame, id: str, text: str, kind: str = "long", **limits) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *c) for i, t in zip(b[id], b[text], strict=True) for c in markdown_chunks(t or "", **limits)]
            yield pd.DataFrame(rows, columns=[id, "chunk_index", "heading_path", "content"])

    return docs.select(id, text).mapInPandas(cut, f"{id} {kind}, chunk_index long, heading_path array<string>, content string")


def readme_description(text: Column) -> Column:
    """First line that is neither blank, heading nor badge, up to 200 characters."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("![") & ~x.startswith("[!") & ~x.startswith("<"))
    return F.substring(F.get(kept, F.lit(0)), 1, 200)


def title(text: Column, path: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^\s*# (.*)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.element_at(F.split(path, "/"), -1))
