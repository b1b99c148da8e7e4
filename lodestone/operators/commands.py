"""Command-line commands of Go sources: their names, their place under other commands, and their flags.

Each file is read by itself for command literals (with the variable that holds them), registrations of one command under another,
and flags. The rest are joins over all files: a variable names the literal that comes last, a command's parent is the first that registers it, in
the order of paths and places. Paths up to the root are found by pointer doubling, so a chain of n commands takes about log2(n) rounds;
a chain that runs into a circle ends where it would repeat a command.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.code import _Tokens
from lodestone.sources.shared import stored

# Types of command literals with the field that names them, and calls that define flags.
LITERALS = {"cobra.Command": "Use", "cli.Command": "Name", "cli.App": "Name"}
COBRA_FLAGS = (
    "String", "StringP", "StringVar", "StringVarP", "Int", "IntP", "IntVar", "IntVarP", "Bool", "BoolP", "BoolVar", "BoolVarP", "Float64",
    "Float64P", "Float64Var", "Float64VarP", "Duration", "DurationP", "DurationVar", "DurationVarP", "StringSlice", "StringSliceP", "StringSliceVar",
    "StringSliceVarP", "Var", "VarP",
)
GO_FLAGS = (
    "String", "StringVar", "Int", "IntVar", "Int64", "Int64Var", "Bool", "BoolVar", "Float64", "Float64Var", "Duration", "DurationVar", "Var",
)

FACTS = "path string, place int, kind string, var string, name string, start_line int, end_line int"


def _facts(path: str, code: str) -> Iterator[tuple]:
    """Rows of FACTS: kinds are command (var holds it), child (name under var), flag (name of the command in var) and go_flag."""
    t = _Tokens(code, "go")
    newlines = [k for k, c in enumerate(code) if c == "\n"]
    line = lambda at: bisect_right(newlines, at - 1) + 1

    def chain_before(k: int) -> str:
        """The names joined by points that end at k."""
        first = k
        while t.text[first - 1] == "." and first >= 2 and t.is_name(first - 2):
            first -= 2
        return "".join(t.text[first : k + 1])

    def first_string(opening: int) -> str:
        k = opening + 1
        while k < t.pair[opening]:
            if t.kind[k] == "text" and t.text[k][0] == '"':
                return t.text[k].strip('"')
            k = t.after(k)
        return ""

    def field(opening: int, name: str) -> str:
        k = opening + 1
        while k < t.pair[opening]:
            if t.text[k] == name and t.text[k + 1] == ":" and t.text[k - 1] in ("{", ",") and t.text[k + 2][:1] == '"' and t.text[k + 3] in (",", "}"):
                return t.text[k + 2][1:-1]
            k = t.after(k)
        return ""

    held: list[tuple[int, str]] = []  # (where its statement ends, variable), the innermost last
    for k in range(len(t)):
        while held and held[-1][0] <= k:
            held.pop()
        word = t.text[k]
        if t.kind[k] == "mark" and word in ("=", ":=") and k and t.text[k + 1] != "=" and t.text[k - 1] not in ("=", "!", "<", ">"):
            left = k - 1
            while left > 0 and not t.fresh[left] and t.text[left - 1] not in ("{", ";", "(", "var", "const"):
                left -= 1
            stop = left
            while stop < k and t.text[stop] != ",":
                stop += 1
            name = "".join(t.text[left : min(stop, left + 1) if t.text[left + 1] != "." else stop])
            held.append((t.line_end(k + 1, len(t)), name))
        if not t.is_name(k):
            continue
        if t.text[k + 1] == "." and f"{word}.{t.text[k + 2]}" in LITERALS and t.text[k + 3] == "{" and t.text[k - 1] != ".":
            if name := field(k + 3, LITERALS[f"{word}.{t.text[k + 2]}"]):
                yield path, k, "command", held[-1][1] if held else "", name, line(t.start[k]), line(t.start[t.pair[k + 3]])
        elif word == "AddCommand" and k >= 2 and t.text[k - 1] == "." and t.text[k + 1] == "(" and t.is_name(k - 2):
            parent, a = chain_before(k - 2), k + 2
            while a < t.pair[k + 1]:
                b = a
                while b < t.pair[k + 1] and t.text[b] != ",":
                    b = t.after(b)
                yield path, a, "child", parent, "".join(t.text[a:b]), line(t.start[a]), None
                a = b + 1
        elif word in COBRA_FLAGS and t.text[k + 1] == "(" and t.text[k - 4 : k] in (["Flags", "(", ")", "."], ["PersistentFlags", "(", ")", "."]) and k >= 6 and t.text[k - 5] == "." and t.is_name(k - 6):
            if name := first_string(k + 1):
                yield path, k, "flag", chain_before(k - 6), name, line(t.start[k]), None
        elif word in GO_FLAGS and t.text[k + 1] == "(" and k >= 2 and t.text[k - 2 : k] == ["flag", "."] and t.text[k - 3 : k - 2] != ["."]:
            if name := first_string(k + 1):
                yield path, k, "go_flag", "", name, line(t.start[k - 2]), line(t.start[t.pair[k + 1]])


def facts(files: DataFrame) -> DataFrame:
    """Rows of FACTS of Go files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([r for p, c in zip(b["path"], b["content"], strict=True) if c for r in _facts(p, c)], columns=[x.split()[0] for x in FACTS.split(", ")])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("path", "content").mapInPandas(run, FACTS)


def ancestors(parents: DataFrame) -> DataFrame:
    """(var, above): from each var of parents(var, parent), one row each, all that it lies under, the nearest first, each once."""
    chains = stored(parents.select("var", F.col("parent").alias("up"), F.array("parent").alias("above")), "commands-chains")
    while not chains.where("up IS NOT NULL").isEmpty():
        further = chains.select(F.col("var").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"))
        both = chains.join(further, "up", "left").withColumn("whole", F.concat("above", F.coalesce("more", F.array().cast("array<string>"))))
        once = F.array_distinct("whole")
        again = F.size(once) < F.size("whole")  # a circle: nothing new lies above
        chains = stored(both.select("var", F.when(~again, F.col("next")).alias("up"), once.alias("above")), "commands-chains")
    return chains.select("var", "above")


def commands(files: DataFrame) -> DataFrame:
    """(name, parent_path, flags, path, start_line, end_line) of the commands of Go files(path, content).

    parent_path joins the names of the commands above by slashes, the root's first; those of unknown variables are left out. Flags of a command are those
    that its own file defines through its variable. Calls of the package ``flag`` under cmd/<name>/ make up one command of that name.
    """
    found = stored(facts(files), "commands-facts")
    order = F.struct("path", "place")
    literals = found.where("kind = 'command'")
    named = literals.where("var != ''").groupBy("var").agg(F.max_by("name", order).alias("name"))
    parents = found.where("kind = 'child' AND name != ''").groupBy(F.col("name").alias("var")).agg(F.min_by("var", order).alias("parent"))
    above = ancestors(parents).select("var", F.posexplode("above").alias("far", "up"))
    above = above.join(named.select(F.col("var").alias("up"), F.col("name").alias("of")), "up")
    paths = above.groupBy("var").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("far", "of")))), lambda x: x["of"]), "/").alias("parent_path"))
    # Of literals that one variable holds in a file, the last gets its flags.
    last = literals.where("var != ''").groupBy("path", "var").agg(F.max("place").alias("place"))
    flags = found.where("kind = 'flag'").groupBy("path", "var").agg(F.array_sort(F.collect_set("name")).alias("flags")).join(last, ["path", "var"]).select("path", "place", "flags")
    none = F.array().cast("array<string>")
    own = literals.join(paths, "var", "left").join(flags, ["path", "place"], "left").select("name", F.coalesce("parent_path", F.lit("")).alias("parent_path"), F.coalesce("flags", none).alias("flags"), "path", "place", "start_line", "end_line")
    first = own.groupBy("parent_path", "name", "path").agg(F.min_by(F.struct("flags", "start_line", "end_line"), "place").alias("c"))
    own = first.select("name", "parent_path", "c.flags", "path", "c.start_line", "c.end_line")
    sites = found.where("kind = 'go_flag'").withColumn("binary", F.regexp_extract("path", "^cmd/([^/]+)", 1)).where("binary != ''")
    plain = sites.groupBy("binary").agg(F.array_sort(F.collect_set("name")).alias("flags"), F.min_by("path", order).alias("path"), F.min_by("start_line", order).alias("start_line"), F.max_by("end_line", order).alias("end_line"))
    return own.unionByName(plain.select(F.col("binary").alias("name"), F.lit("").alias("parent_path"), "flags", "path", "start_line", "end_line"))
