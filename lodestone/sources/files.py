"""Source trees and document uploads as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T

# Extensions of the languages that are parsed, and of those that are only counted.
GRAPH_LANGUAGES = {
    ".py": "python", ".pyi": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
}
MORE_LANGUAGES = {
    ".java": "java", ".kt": "kotlin", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift",
    ".scala": "scala", ".sh": "shell", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}
FILE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "cmakelists.txt": "cmake", "jenkinsfile": "groovy", "gemfile": "ruby", "rakefile": "ruby"}
MOST_BYTES = 1 << 20
# Folders that are not read, by what reads them; names of configuration files.
SCRIPT_NOISE = ("node_modules", "dist", "build", ".next", ".nuxt", ".output", ".turbo", "coverage")
SHOWN_HIDDEN = (".devcontainer", ".github")
NO_DOCUMENTS = (".cache", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", ".vscode", "__pycache__", "build", "dist", "node_modules", "venv")
SKIPPED = (".git", ".hg", ".svn", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", ".vscode", "__pycache__", "build", "dist", "node_modules", "venv", "vendor")
ROOT_CONFIG = ("compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml", "dockerfile", "go.mod", "go.work", "makefile", "package-lock.json", "package.json", "pyproject.toml")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of a directory's files that are not empty, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + root.rstrip("/").replace("file://", "") + "/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), "content")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def skipped(path: Column) -> Column:
    """Inside a directory that is never read."""
    return F.exists(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda d: d.isin(*SKIPPED))


def _parents(path: Column) -> Column:
    return F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)


def graph_files(files: DataFrame) -> DataFrame:
    """Files that are parsed, in path order: a known language, outside skipped folders; of TypeScript and JavaScript
    none that is built, minified or over 1 MiB."""
    out = files.withColumn("language", T.bare_language(F.col("path"), GRAPH_LANGUAGES)).where(F.col("language").isNotNull() & ~skipped(F.col("path")))
    noise = F.exists(_parents(F.col("path")), lambda d: d.isin(*SCRIPT_NOISE)) | F.col("path").rlike(r"(?i)\.min\.[cm]?js$") | (F.col("size") > MOST_BYTES)
    return out.where(~(F.col("language").isin("typescript", "javascript") & noise)).orderBy("path")


def documents(files: DataFrame) -> DataFrame:
    """Files with the ``kind`` of document that they are, in path order; those that are none, and those below hidden or
    ignored folders, are left out."""
    hidden = F.exists(_parents(F.col("path")), lambda d: ~d.isin(*SHOWN_HIDDEN) & (d.startswith(".") | d.isin(*NO_DOCUMENTS)))
    return files.withColumn("kind", document_kind(F.col("path"))).where(F.col("kind").isNotNull() & ~hidden).orderBy("path")


def language(path: Column) -> Column:
    """By whole file name, else by extension."""
    names = F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv])
    return F.coalesce(names[F.lower(name(path))], T.bare_language(path, GRAPH_LANGUAGES | MORE_LANGUAGES))


def language_bytes(files: DataFrame) -> DataFrame:
    """(language, bytes) of files of 1 byte to 1 MiB outside skipped directories."""
    known = files.where((F.col("size") > 0) & (F.col("size") <= MOST_BYTES) & ~skipped(F.col("path"))).withColumn("language", language(F.col("path")))
    return known.where("language is not null").groupBy("language").agg(F.sum("size").alias("bytes"))


# Fixed values in this function: folders, names and endings of each kind, and the order of its rules.
def document_kind(path: Column) -> Column:
    """Kind of a document by its path, null if it is none; the first rule that fits decides."""
    parts = F.transform(F.split(path, "/"), F.lower)
    low, suffix = F.lower(name(path)), F.lower(F.regexp_extract(name(path), r".(\.[^.]+)$", 1))
    docs, among = suffix.isin(".md", ".mdx", ".rst"), lambda *d: F.exists(parts, lambda p: p.isin(*d))
    return (
        F.when(docs, "Repo Doc")
        .when((parts[0] == ".github") & (F.size(parts) >= 2) & (F.get(parts, F.lit(1)) == "workflows") & suffix.isin(".yml", ".yaml"), "Workflow")
        .when(among("example", "examples", "sample", "samples") & suffix.isin(".go", ".js", ".json", ".jsx", ".py", ".toml", ".ts", ".tsx", ".yaml", ".yml"), "Example")
        .when(among("test", "tests") & suffix.isin(".go", ".js", ".py", ".ts") & (low.startswith("test_") | low.endswith("_test.go")), "Test")
        .when(low.isin(*ROOT_CONFIG), "Config")
        .when(low.startswith(".env") | (suffix == ".env"), "Config")
        .when(parts[0].isin(".devcontainer", "deploy", "deployment", "helm", "k8s", "ops") & suffix.isin(".cfg", ".conf", ".env", ".ini", ".json", ".toml", ".yaml", ".yml"), "Config")
    )


def blame_lines(hunks: DataFrame) -> DataFrame:
    """(path, line, sha, committed_at) of hunks(path, first, count, sha, committed_epoch)."""
    line = F.explode(F.expr("sequence(first, first + count - 1)"))
    return hunks.where("count > 0").select("path", line.alias("line"), "sha", F.timestamp_seconds("committed_epoch").alias("committed_at"))


def blame_hunks(blames: DataFrame) -> DataFrame:
    """(path, first, count, sha, committed_epoch) of blames(path, text), each an incremental blame: a line of commit,
    old place, new place and length, then fields, which a commit has only where it comes first."""
    entry = F.explode(F.split(F.concat(F.lit("\n"), "text"), r"\n(?=[0-9a-f]{40} \d+ \d+ \d+(?:\n|$))"))
    rows = blames.select("path", entry.alias("e")).where(F.col("e").rlike(r"^[0-9a-f]{40} \d+ \d+ \d+"))
    part = lambda n: F.split_part(F.split_part("e", F.lit("\n"), F.lit(1)), F.lit(" "), F.lit(n))
    rows = rows.select("path", part(3).cast("int").alias("first"), part(4).cast("int").alias("count"), part(1).alias("sha"), F.nullif(F.regexp_extract("e", r"(?m)^committer-time (\d+)$", 1), F.lit("")).cast("long").alias("own"))
    at = F.max("own").over(W.partitionBy("path", "sha"))
    return rows.withColumn("committed_epoch", at).drop("own")


def changes_of(text: DataFrame) -> DataFrame:
    """(kind, path, old_path) of name-status lines(value): A, M, D, R; copies count as added."""
    p = F.split("value", "\t")
    kind = F.substring(p[0], 1, 1)
    kept = text.where(kind.isin("A", "M", "D", "R", "C", "T"))
    mapped = F.when(kind == "C", "A").when(kind == "T", "M").otherwise(kind)
    return kept.select(mapped.alias("kind"), F.element_at(p, -1).alias("path"), F.when(kind == "R", F.get(p, F.lit(1))).alias("old_path"))


MOST_ENTRIES, MOST_UNPACKED, MOST_RATIO = 20_000, 1 << 30, 100


def ignore_rules(text: str) -> list[tuple[re.Pattern[str], bool]]:
    """(pattern, keep) of the lines of a .gitignore file: ``*``, ``?``, ``**``, a leading or inner slash for its own
    folder, a trailing one for folders, ``!`` to keep."""
    rules = []
    for line in (x.rstrip() for x in text.splitlines()):
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.lstrip("!")
        folder, bare = line.endswith("/"), line.strip("/")
        parts = re.split(r"(\*\*/|/\*\*|\*|\?)", bare)
        body = "".join({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in parts)
        anchored = "/" in line.rstrip("/")
        rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?")), keep))
    return rules


def is_ignored(path: str, rules: list[tuple[re.Pattern[str], bool]]) -> bool:
    """By the last rule that fits."""
    return next((not keep for pattern, keep in reversed(rules) if pattern.fullmatch(path)), False)


def zip_entries(raw: bytes) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(path, size, content, error) of an archive's files. Entries that leave the archive's folder, are
    links, unpack to over MOST_RATIO times their size, or come after a limit are refused with an error; those that
    the archive's own .gitignore leaves out are not given."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        yield "", 0, None, str(e)
        return
    total, rules = 0, []
    if ".gitignore" in archive.NameToInfo and archive.NameToInfo[".gitignore"].file_size <= MOST_BYTES:
        rules = ignore_rules(archive.read(".gitignore").decode(errors="replace"))
    for n, entry in enumerate(i for i in archive.infolist() if not i.is_dir()):
        path = entry.filename.replace("\\", "/")
        if is_ignored(path, rules):
            continue
        total += entry.file_size
        error = (
            "too many entries" if n >= MOST_ENTRIES
            else "leaves its folder" if path.startswith("/") or ".." in path.split("/") or ":" in path.split("/")[0]
            else "is a link" if (entry.external_attr >> 16) & 0o170000 == 0o120000
            else "unpacks too large" if total > MOST_UNPACKED or entry.file_size > MOST_RATIO * max(entry.compress_size, 1) and entry.file_size > MOST_BYTES
            else None
        )
        yield path, entry.file_size, None if error else archive.read(entry), error


def unpacked(archives: DataFrame) -> DataFrame:
    """(archive, path, size, content, error) of all files in the zip archives(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, raw in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(archive, *e) for e in zip_entries(raw)], columns=["archive", "path", "size", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, size long, content binary, error string")


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, size, content, error) of all files in zip archives below a path."""
    return unpacked(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path))


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
