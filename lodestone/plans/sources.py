"""Queries over source trees, change feeds, code and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as T
from lodestone.operators import code as C
from lodestone.operators import documents as D
from lodestone.operators import extract as X
from lodestone.operators import graph as G
from lodestone.operators import hybrid as H
from lodestone.operators import incremental as I
from lodestone.operators import pages as P
from lodestone.operators import wiki as K
from lodestone.operators.commands import commands
from lodestone.plans.tables import spread, table
from lodestone.sources import files as S
from lodestone.sources.shared import new_path, stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TREE = ("src/a{k}.py", "web/node_modules/b{k}.ts", "web/c{k}.min.js", "web/d{k}.tsx", "vendor/e{k}.go", "cmd/f{k}.go", "dist/g{k}.js", "h{k}.txt", ".venv/i{k}.py", "j{k}.pyi", "Makefile", "k{k}.RS")
_DOCS = ("README.md", ".github/workflows/w{k}.yml", "examples/e{k}.py", "tests/test_a{k}.py", "tests/h{k}.py", ".hidden/x{k}.md", "node_modules/p{k}.md", "deploy/a{k}.yaml", ".env.l{k}", "src/m{k}.py", "x/go.mod", "docs/q{k}.rst")
_KINDS = ("Repo Doc", "Workflow", "Example", "Test", None, None, None, "Config", "Config", None, "Config", "Repo Doc")


def _tree_sql(names: tuple[str, ...], k: str = "p_partkey") -> str:
    return "[" + ", ".join("'" + n.replace("{k}", f"' || {k} || '") + "'" for n in names) + f"][{k} % {len(names)} + 1]"


def _tree(spark, sf_dir, names: tuple[str, ...]):
    """A file of a kind for each part; its size goes with the part's, so that some are over 1 MiB or empty."""
    k = F.col("p_partkey").cast("string")
    made = F.array(*(F.concat(*(F.lit(x) if j % 2 == 0 else k for j, x in enumerate(n.replace("{k}", "|k|").split("|")))) for n in names))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(made, (F.col("p_partkey") % len(names) + 1).cast("int")).alias("path"), (F.col("p_size").cast("long") * 30000 - 30000).alias("size"))


@query(f"SELECT path, language, size FROM (SELECT {_tree_sql(_TREE)} AS path, ['python', '', '', 'typescript', '', 'go', '', '', '', 'python', '', ''][p_partkey % 12 + 1] AS language, p_size::BIGINT * 30000 - 30000 AS size FROM part) WHERE language <> '' AND NOT (language = 'typescript' AND size > 1048576)")
def source_discovery(spark, sf_dir):
    return S.graph_files(_tree(spark, sf_dir, _TREE)).select("path", "language", "size")


@query(f"SELECT path, kind FROM (SELECT {_tree_sql(_DOCS)} AS path, {[k or '' for k in _KINDS]}[p_partkey % 12 + 1] AS kind FROM part) WHERE kind <> ''")
def document_discovery(spark, sf_dir):
    return S.documents(_tree(spark, sf_dir, _DOCS)).select("path", "kind")


@query(f"SELECT {_tree_sql(_TREE)} AS path, ['python', 'typescript', 'javascript', 'typescript', 'go', 'go', 'javascript', NULL, 'python', 'python', 'makefile', 'rust'][p_partkey % 12 + 1] AS language FROM part")
def language_of_files(spark, sf_dir):
    return _tree(spark, sf_dir, _TREE).select("path", S.language(F.col("path")).alias("language"))


@query("SELECT ['A', 'M', 'D', 'R', 'A', 'M'][o_orderkey % 7 + 1] AS kind, 'n' || o_orderkey || '.py' AS path, CASE WHEN o_orderkey % 7 = 3 THEN 'o' || o_orderkey || '.py' END AS old_path FROM orders WHERE o_orderkey % 7 < 6")
def change_feed(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R090", "C075", "T", "X"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    new, old = (F.concat(F.lit(x), F.col("o_orderkey").cast("string"), F.lit(".py")) for x in "no")
    return S.changes_of(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 == 3, F.concat_ws("\t", mark, old, new)).otherwise(F.concat_ws("\t", mark, new)).alias("value")))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), t AS (SELECT k, p, min(i) AS i FROM l GROUP BY k, p)
    SELECT 'f' || k AS path, (i - 1) * 3 + u.o AS line, lpad(p::VARCHAR, 40, '0') AS sha, p * 1000 AS epoch FROM l, (VALUES (1), (2), (3)) u(o)""")
def blame_lines(spark, sf_dir):
    """Each line of an order is a hunk of three lines; a commit tells its time where it comes first."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("i"))
    rows = rows.withColumn("first", F.row_number().over(W.partitionBy("l_orderkey", "l_partkey").orderBy("i")) == 1)
    at = ((F.col("i") - 1) * 3 + 1).cast("string")
    head = F.concat_ws(" ", F.lpad(F.col("l_partkey").cast("string"), 40, "0"), at, at, F.lit("3"))
    entry = F.concat(head, F.when(F.col("first"), F.concat(F.lit("\nauthor x\ncommitter-time "), (F.col("l_partkey") * 1000).cast("string"))).otherwise(""), F.lit("\nfilename f\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))), lambda x: x["e"]), "")
    blames = rows.groupBy("l_orderkey").agg(text.alias("text")).select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"), "text")
    return S.blame_lines(S.blame_hunks(blames)).select("path", "line", "sha", F.unix_seconds("committed_at").alias("epoch"))


#: Documents whose line ends are made carriage returns, both, form feeds or separators by their id.
_ENDS = ("\n", "\r\n", "\r", "\x0c", " ", "\x85")


@query(r"""WITH t AS (SELECT doc_id, regexp_split_to_array(replace(coalesce(text, ''), chr(10), [chr(10), chr(13) || chr(10), chr(13), chr(12), chr(8232), chr(133)][doc_id % 6 + 1]), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents), n AS (SELECT *, CASE WHEN l[len(l)] = '' THEN len(l) - 1 ELSE len(l) END AS n FROM t)
    SELECT doc_id, array_to_string(l[2:least(n, 4)::BIGINT], chr(10)) AS body, least(n, 4)::INT AS last FROM n""")
def line_ranges(spark, sf_dir):
    """Lines two to four, whatever ends them."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    body, last, _ = T.lines(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), end), 2, 4)
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), last.cast("int").alias("last"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'stored' ELSE substring(p_name, 2, 4) END AS body FROM part")
def node_bodies(spark, sf_dir):
    """Nodes of bytes 1 to 5 of a file with the part's name; every third file is missing."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    files = p.where("p_partkey % 3 != 0").select(path.alias("path"), F.col("p_name").cast("binary").alias("content"))
    nodes = p.select(F.col("p_partkey").alias("id"), path.alias("file_path"), F.lit(1).alias("start_byte"), F.lit(5).alias("end_byte"), F.lit("stored").alias("content"))
    return D.node_bodies(nodes, files).select("id", "body")


@query("""WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '+' ELSE '' END) AS h FROM documents WHERE doc_id % 2 = 0)
    SELECT 'c' || doc_id % 4 AS collection, 'd' || doc_id AS source_key, CASE WHEN o.h IS NULL THEN doc_id + 1000000 ELSE doc_id END AS id, CASE WHEN o.h IS NULL THEN 'insert' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action FROM n LEFT JOIN o USING (doc_id)""")
def document_uploads(spark, sf_dir):
    """A batch of uploads, known by collection and source key; equal content is kept."""
    d = table(spark, sf_dir, "documents")
    keys = [F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("collection"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_key")]
    text = F.coalesce("text", F.lit(""))
    old = d.where("doc_id % 3 != 0").select(*keys, F.col("doc_id").alias("id"), F.sha2(text, 256).alias("h"))
    new = d.where("doc_id % 2 = 0").select(*keys, (F.col("doc_id") + 1000000).alias("id"), F.sha2(F.concat(text, F.when(F.col("doc_id") % 5 == 0, "+").otherwise("")), 256).alias("h"))
    return I.merge(old, new, ["collection", "source_key"], "id", "h").select("collection", "source_key", "id", "action")


@query("SELECT o_orderstatus AS tenant, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def partitioned_sink(spark, sf_dir):
    """Written by tenant and read back for two of them, from their folders alone."""
    path = new_path(spark, "sink")
    S.write_table(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "tenant"), path, "tenant")
    return spark.read.parquet(path).where("tenant != 'P'").groupBy("tenant").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'entry_point' WHEN 1 THEN 'test' WHEN 2 THEN 'service' WHEN 3 THEN 'repository' WHEN 4 THEN 'model' WHEN 5 THEN 'helper' WHEN 6 THEN 'constant' WHEN 7 THEN 'config' WHEN 8 THEN 'model' ELSE 'other' END AS role FROM part""")
def node_roles(spark, sf_dir):
    i = (F.col("p_partkey") % 10 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), i)
    kind = pick("function", "function", "class", "struct", "class", "method", "variable", "module", "class", "class")
    name = pick("list_parts", "test_it", "PartService", "PartRepo", "PartModel", "_inner", "LIMIT", "settings", "Part", "Part")
    none = F.array().cast("array<string>")
    decorators = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit("@router.get('/')"))).otherwise(none)
    bases = F.when(F.col("p_partkey") % 10 == 8, F.array(F.lit("pydantic.BaseModel"))).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", X.role(kind, name, decorators, bases).alias("role"))


_MODULE = "import os\nfrom . import util as u\n\n\nclass Base:\n    pass\n\n\nclass Child(Base):\n    LIMIT = 3\n\n    def run(self, n: int) -> int:\n        return u.double(self.step(n))\n\n    def step(self, n):\n        return os.path.join('a', str(n))\n\n\ndef main():\n    return Child().run(1)\n"
#: ^ stands for the part's brand; as many functions or classes follow as the part's size asks for.
_GO = """package store

import (
	"fmt"
	log "example.com/lib/log"
)

type (
	Base struct {
		io.Reader
		Name string `json:"x"`
	}
	Kind^ int
	Reader^ interface { Read^(p []byte) (int, error); fmt.Stringer }
)

type Store struct {
	*Base
	n int
}

const Limit = 3

func init() { fmt.Println("func x() {") }

func New^[T any](m map[string]struct{}) *Store {
	return &Store{}
}

func (s *Store) Get(id string) (string, error) {
	f := func() { s.hidden(id) }
	f()
	s.load(id)
	return log.Wrap^(id), nil
}

func (s *Store) load(id string) {}
"""
_TS = """import React, { useState as st } from './react';
import * as util from '../lib/util';
export { a } from './barrel';

export class A^<T> extends Base<T> implements I {
  private secret = "x";
  onClick = (e: Event) => { this.audit^(e); };
  constructor(private x: number) { super(x); this.init(); }
  async run(n: { a: number }): Promise<void> {
    const f = () => { util.go(n); };
    if (/\\{/.test(n) ) { function inner() { deep(`a ${wrap(`b ${n}`)} }`); } }
    return this.step(n);
  }
}
export interface I extends K { go(): void; name: string }
enum E { X = 1 }
type Alias = string | number;
export const arrow = async (x: number): Promise<void> => {
  st(x);
};
const MAX = 3, dep = require("./dep^");
namespace N { function q() { w(); } }
export default function (o = {}) {
  return arrow(3);
}
module.exports = { MAX };
"""
_GO_LINES, _TS_LINES = _GO.count("\n"), _TS.count("\n")


def _code(spark, sf_dir):
    """A Go, a TypeScript or a Python file for each part."""
    k, i = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    path = F.when(i == 0, F.concat(F.lit("internal/s"), k, F.lit("/store.go"))).when(i == 1, F.concat(F.lit("src/app"), k, F.lit("/main.ts"))).otherwise(F.concat(F.lit("pkg/m"), k, F.lit(".py")))
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    more = lambda text: F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda j: F.when(j > 0, F.replace(F.lit(text), F.lit("^"), j.cast("string")))), "")
    go = F.concat(F.replace(F.lit(_GO), F.lit("^"), brand), more("func Extra^(a int) error { return call^.Do(a) }\n"))
    ts = F.concat(F.replace(F.lit(_TS), F.lit("^"), brand), more("class More^ extends A { f = () => go^(1) }\n"))
    content = F.when(i == 0, go).when(i == 1, ts).otherwise(F.replace(F.lit(_MODULE), F.lit("LIMIT"), brand))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return parts.select(path.alias("path"), content.alias("content"), F.element_at(F.array(*map(F.lit, ("go", "typescript", "python"))), (i + 1).cast("int")).alias("language"))


_BRAND = "replace(p_brand, '#', '')"


def _named_sql(column: str, prefix: str) -> str:
    return f"replace(replace({column}, '~', {prefix} || p_partkey), '^', {_BRAND})"


def _rows_sql(remainder: int, prefix: str, columns: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"SELECT {_named_sql('u.n', prefix)} AS qualified_name, u.* EXCLUDE (n) FROM part, (VALUES {values}) u(n, {columns}) WHERE p_partkey % 3 = {remainder}"


def _more_sql(remainder: int, select: str) -> str:
    return f"SELECT {select} FROM part, range(1, 4) r(j) WHERE p_partkey % 3 = {remainder} AND j <= p_size % 4"


_NODES = " UNION ALL ".join([
    _rows_sql(0, "'internal.s'", "node_type, start_line, end_line", [("~.Base", "struct", 9, 12), ("~.Kind^", "type_alias", 13, 13), ("~.Reader^", "interface", 14, 14), ("~.Reader^.Read^", "method", 14, 14), ("~.Store", "struct", 17, 20), ("~.init@store", "function", 24, 24), ("~.New^", "function", 26, 28), ("~.Store.Get", "method", 30, 35), ("~.Store.load", "method", 37, 37)]),
    f"SELECT 'internal.s' || p_partkey || '.store#module', 'module', 1, {_GO_LINES} + p_size % 4 FROM part WHERE p_partkey % 3 = 0",
    _more_sql(0, f"'internal.s' || p_partkey || '.Extra' || j, 'function', {_GO_LINES} + j, {_GO_LINES} + j"),
    _rows_sql(1, "'src.app'", "node_type, start_line, end_line", [("~.main.A^", "class", 5, 14), ("~.main.A^.secret", "attribute", 6, 6), ("~.main.A^.onClick", "method", 7, 7), ("~.main.A^.constructor", "method", 8, 8), ("~.main.A^.run", "method", 9, 13), ("~.main.I", "interface", 15, 15), ("~.main.I.go", "method", 15, 15), ("~.main.I.name", "attribute", 15, 15), ("~.main.E", "class", 16, 16), ("~.main.Alias", "type_alias", 17, 17), ("~.main.arrow", "function", 18, 20), ("~.main.MAX", "constant", 21, 21), ("~.main.default", "function", 23, 25)]),
    f"SELECT 'src.app' || p_partkey || '.main', 'module', 1, {_TS_LINES} + p_size % 4 FROM part WHERE p_partkey % 3 = 1",
    _more_sql(1, f"'src.app' || p_partkey || '.main.More' || j, 'class', {_TS_LINES} + j, {_TS_LINES} + j"), _more_sql(1, f"'src.app' || p_partkey || '.main.More' || j || '.f', 'method', {_TS_LINES} + j, {_TS_LINES} + j"),
])


@query(_NODES)
def code_nodes(spark, sf_dir):
    return C.nodes(_code(spark, sf_dir)).select("qualified_name", "node_type", "start_line", "end_line")


def _edges_sql(remainder: int, prefix: str, rows: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{a}', '{t}', '{b}')" for a, t, b in rows)
    return f"SELECT {_named_sql('a', prefix)} AS source, t AS type, {_named_sql('b', prefix)} AS target FROM part, (VALUES {values}) u(a, t, b) WHERE p_partkey % 3 = {remainder}"


_G, _M = "~.store#module", "~.main"
_EDGES = " UNION ALL ".join([
    _edges_sql(0, "'internal.s'", [
        (_G, "imports", "fmt"), (_G, "imports", "example.com.lib.log as log"), (_G, "declares", "~.Base"), ("~.Base", "inherits", "io.Reader"), (_G, "declares", "~.Kind^"), (_G, "declares", "~.Reader^"), ("~.Reader^", "inherits", "fmt.Stringer"), ("~.Reader^", "declares", "~.Reader^.Read^"), (_G, "declares", "~.Store"), ("~.Store", "inherits", "~.Base"), (_G, "declares", "~.init@store"), (_G, "declares", "~.New^"),
        ("~.Store", "declares", "~.Store.Get"), ("~.Store", "declares", "~.Store.load"), ("~.init@store", "calls", "fmt.Println"), ("~.Store.Get", "calls", "s.load"), ("~.Store.Get", "calls", "f"), ("~.Store.Get", "calls", "log.Wrap^"),
    ]),
    _more_sql(0, "'internal.s' || p_partkey || '.store#module', 'declares', 'internal.s' || p_partkey || '.Extra' || j"), _more_sql(0, "'internal.s' || p_partkey || '.Extra' || j, 'calls', 'call' || j || '.Do'"),
    _edges_sql(1, "'src.app'", [
        (_M, "imports", "~.react.default as React"), (_M, "imports", "~.react.useState as st"), (_M, "imports", "src.lib.util as util"), (_M, "imports", "~.barrel.a"), (_M, "imports", "~.dep^ as dep"), (_M, "declares", "~.main.A^"), ("~.main.A^", "inherits", "Base"), ("~.main.A^", "inherits", "I"),
        ("~.main.A^", "declares", "~.main.A^.secret"), ("~.main.A^", "declares", "~.main.A^.onClick"), ("~.main.A^.onClick", "calls", "this.audit^"), ("~.main.A^", "declares", "~.main.A^.constructor"), ("~.main.A^", "declares", "~.main.A^.run"), (_M, "declares", "~.main.I"), ("~.main.I", "inherits", "K"), ("~.main.I", "declares", "~.main.I.go"), ("~.main.I", "declares", "~.main.I.name"), (_M, "declares", "~.main.E"), (_M, "declares", "~.main.Alias"), (_M, "declares", "~.main.arrow"), (_M, "declares", "~.main.MAX"), (_M, "declares", "~.main.default"),
        ("~.main.A^.constructor", "calls", "this.init"), ("~.main.A^.run", "calls", "util.go"), ("~.main.A^.run", "calls", "deep"), ("~.main.A^.run", "calls", "wrap"), ("~.main.A^.run", "calls", "this.step"), ("~.main.arrow", "calls", "st"), ("~.main.default", "calls", "arrow"),
    ]),
    _more_sql(1, "'src.app' || p_partkey || '.main', 'declares', 'src.app' || p_partkey || '.main.More' || j"), _more_sql(1, "'src.app' || p_partkey || '.main.More' || j, 'inherits', 'A'"),
    _more_sql(1, "'src.app' || p_partkey || '.main.More' || j, 'declares', 'src.app' || p_partkey || '.main.More' || j || '.f'"), _more_sql(1, "'src.app' || p_partkey || '.main.More' || j || '.f', 'calls', 'go' || j"),
])


@query(_EDGES)
def code_edges(spark, sf_dir):
    return C.edges(_code(spark, sf_dir)).select("source", "type", "target")


@query(_rows_sql(0, "'internal.s'", "is_default", [(n, 0) for n in ("~.Base", "~.Kind^", "~.Reader^", "~.Reader^.Read^", "~.Store", "~.New^", "~.Store.Get")]).replace("u.* EXCLUDE (n)", "u.is_default = 1 AS is_default") + " UNION ALL "
       + _rows_sql(1, "'src.app'", "is_default", [(n, int(n.endswith("default"))) for n in ("~.main.A^", "~.main.A^.onClick", "~.main.A^.constructor", "~.main.A^.run", "~.main.I", "~.main.I.go", "~.main.I.name", "~.main.arrow", "~.main.MAX", "~.main.default")]).replace("u.* EXCLUDE (n)", "u.is_default = 1")
       + " UNION ALL " + _more_sql(0, "'internal.s' || p_partkey || '.Extra' || j, false"))
def code_exports(spark, sf_dir):
    """What files let others use: capitals in Go, export statements and CommonJS in scripts."""
    return C.exports(_code(spark, sf_dir)).select("qualified_name", "is_default")


@query(_rows_sql(2, "'pkg.m'", "node_type, start_line, end_line, role", [("~", "module", 1, 21, "other"), ("~.Base", "class", 5, 6, "other"), ("~.Child", "class", 9, 16, "other"), ("~.Child.^", "attribute", 10, 10, "attribute"), ("~.Child.run", "method", 12, 13, "other"), ("~.Child.step", "method", 15, 16, "other"), ("~.main", "function", 19, 20, "other")]))
def python_ast_graph(spark, sf_dir):
    n = X.python_nodes(_code(spark, sf_dir).where("language = 'python'"))
    return n.select("qualified_name", "node_type", "start_line", "end_line", X.role(F.col("node_type"), F.col("name"), F.col("decorators"), F.col("bases")).alias("role"))


@query(_edges_sql(2, "'pkg.m'", [("~", "imports", "os"), ("~", "imports", ".util as u"), ("~", "declares", "~.Base"), ("~", "declares", "~.Child"), ("~.Child", "inherits", "Base"), ("~.Child", "declares", "~.Child.^"), ("~.Child", "declares", "~.Child.run"), ("~.Child.run", "calls", "u.double"), ("~.Child.run", "calls", "self.step"), ("~.Child", "declares", "~.Child.step"), ("~.Child.step", "calls", "os.path.join"), ("~.Child.step", "calls", "str"), ("~", "declares", "~.main"), ("~.main", "calls", "Child")]))
def python_edges(spark, sf_dir):
    return X.python_edges(_code(spark, sf_dir).where("language = 'python'")).select("source", "type", "target")


_RESOLVED = {
    (0, "'internal.s'"): [("~.Store.Get", "s.load", "~.Store.load"), ("~.Store.Get", "log.Wrap^", "example.com.lib.log.Wrap^"), ("~.Store.Get", "f", "~.f"), ("~.init@store", "fmt.Println", "fmt.Println")],
    (1, "'src.app'"): [("~.main.A^.onClick", "this.audit^", "~.main.A^.audit^"), ("~.main.A^.constructor", "this.init", "~.main.A^.init"), ("~.main.A^.run", "this.step", "~.main.A^.step"), ("~.main.A^.run", "deep", "~.main.deep"), ("~.main.A^.run", "wrap", "~.main.wrap"), ("~.main.A^.run", "util.go", "src.lib.util.go"), ("~.main.arrow", "st", "~.react.useState"), ("~.main.default", "arrow", "~.main.arrow")],
}


@query(" UNION ALL ".join(f"SELECT {_named_sql('a', p)} AS source, {_named_sql('raw', p)} AS raw, {_named_sql('b', p)} AS target FROM part, (VALUES {', '.join(str(r) for r in rows)}) u(a, raw, b) WHERE p_partkey % 3 = {k}" for (k, p), rows in _RESOLVED.items())
       + " UNION ALL " + _more_sql(0, "'internal.s' || p_partkey || '.Extra' || j, 'call' || j || '.Do', 'call' || j || '.Do'") + " UNION ALL " + _more_sql(1, "'src.app' || p_partkey || '.main.More' || j || '.f', 'go' || j, 'src.app' || p_partkey || '.main.go' || j"))
def canonical_calls(spark, sf_dir):
    """Calls of Go and TypeScript files by receiver, class, import, package or module."""
    files = _code(spark, sf_dir)
    # Stored, so that each is parsed once and joins know how large it is: what Spark guesses from the small table of parts, it would broadcast.
    nodes = stored(C.nodes(files).select("qualified_name", "file_path", "node_type", "parent", "signature"), "calls-nodes")
    edges = stored(C.edges(files).where("type IN ('imports', 'calls')"), "calls-edges")
    language = F.when(F.col("file_path").endswith(".go"), "go").otherwise("typescript")
    receiver = F.nullif(F.regexp_extract("signature", r"^func \((\w+) ", 1), F.lit(""))
    own = nodes.select(F.col("qualified_name").alias("id"), "qualified_name", "file_path", language.alias("language"), "node_type", F.col("parent").alias("parent_id"), F.coalesce(receiver, F.lit("?")).alias("receiver"))
    package = F.when(F.col("file_path").endswith(".go"), F.replace(F.regexp_replace("file_path", "/[^/]*$", ""), F.lit("/"), F.lit("."))).otherwise(F.col("source"))
    modules = edges.where("type = 'imports'").groupBy("file_path", "source").agg(F.collect_list("target").alias("imports")).select("file_path", package.alias("module"), "imports")
    calls = edges.where("type = 'calls'").select(F.col("source").alias("src"), F.col("target").alias("raw"))
    return G.canonical_calls(calls, own, modules).select(F.col("src").alias("source"), "raw", "target")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), e AS (SELECT 'z' || doc_id AS archive, 'src/a' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS hash, NULL AS error FROM d
    UNION ALL SELECT 'z' || doc_id, '../b' || doc_id, 4, NULL, 'leaves its folder' FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'z' || doc_id, 'link', 4, NULL, 'is a link' FROM d WHERE doc_id % 3 = 0
    UNION ALL SELECT 'z' || doc_id, '.gitignore', 6, sha256('*.log' || chr(10)), NULL FROM d UNION ALL SELECT 'z' || doc_id, 'keep.md', 4, sha256('keep'), NULL FROM d) SELECT * FROM e WHERE archive <> 'z7' UNION ALL SELECT 'z7', '', 0, NULL, 'File is not a zip file' FROM d WHERE doc_id = 7""")
def zip_archives(spark, sf_dir):
    """An archive for each document, with entries that leave its folder, links, and files that its own rules leave out; one is no archive."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def packed(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for k, text in zip(b["doc_id"], b["text"], strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"src/a{k}.txt", text)
                    if k % 2 == 0:
                        z.writestr(f"../b{k}", "evil")
                    if k % 3 == 0:
                        link = zipfile.ZipInfo("link")
                        link.external_attr = 0o120777 << 16
                        z.writestr(link, "away")
                    z.writestr(".gitignore", "*.log\n"), z.writestr("deep/x.log", "lost"), z.writestr("keep.md", "keep")
                out.append((f"z{k}", b"no" if k == 7 else raw.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    found = S.unpacked(docs.mapInPandas(packed, "path string, content binary"))
    return found.select("archive", "path", "size", F.sha2("content", 256).alias("hash"), "error")


#: A command for each part, registered under the one before it, in chains of 24; ^ is the part's key and < the key before it.
_COMMAND = """package main

import "github.com/spf13/cobra"

var cmd^ = &cobra.Command{
	Use:   "u^",
	Short: "Use: \\"x\\"", // Use: "no"
}

func init() {
	cmd<.AddCommand(cmd^, other)
	cmd^.Flags().StringP("f^", "f", "", "use")
	cmd^.PersistentFlags().IntVar(&v, "all", 0, "level")
	stray.Flags().Bool("lost", false, "")
}
"""


@query("""SELECT 'u' || p.p_partkey AS name, coalesce((SELECT string_agg('u' || q.p_partkey, '/' ORDER BY q.p_partkey) FROM part q WHERE q.p_partkey < p.p_partkey AND q.p_partkey >= p.p_partkey - p.p_partkey % 24), '') AS parent_path,
        'all,f' || p.p_partkey AS flags, 'cmd/tool' || p.p_partkey % 7 || '/c' || p.p_partkey || '.go' AS path, 5 AS start_line, 8 AS end_line FROM part p
    UNION ALL SELECT 'tool' || m, '', string_agg(DISTINCT 'g' || k % 4, ',' ORDER BY 'g' || k % 4), min('cmd/tool' || m || '/d' || k || '.go'), 3, 3 FROM (SELECT p_partkey % 7 AS m, p_partkey AS k FROM part WHERE p_partkey % 10 = 0) GROUP BY m""")
def cli_commands(spark, sf_dir):
    """Commands with up to 23 others above them, and programs that only take flags."""
    k = F.col("p_partkey")
    before = F.when(k % 24 == 0, "none").otherwise((k - 1).cast("string"))
    folder = F.concat(F.lit("cmd/tool"), (k % 7).cast("string"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    files = parts.select(F.concat(folder, F.lit("/c"), k.cast("string"), F.lit(".go")).alias("path"), F.replace(F.replace(F.lit(_COMMAND), F.lit("^"), k.cast("string")), F.lit("<"), before).alias("content"))
    plain = parts.where(k % 10 == 0).select(F.concat(folder, F.lit("/d"), k.cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit('package main\n\nvar a = flag.Bool("g'), (k % 4).cast("string"), F.lit('", false, "x")\n')).alias("content"))
    return commands(files.unionByName(plain)).withColumn("flags", F.array_join("flags", ","))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'p.md' ELSE 'Late' END AS title FROM part")
def document_titles(spark, sf_dir):
    i = F.col("p_partkey") % 3
    text = F.when(i == 0, F.concat(F.lit("x\n# "), "p_name", F.lit(" \n# no"))).when(i == 1, F.lit("## only\n#no")).otherwise("intro\n  # Late")
    return table(spark, sf_dir, "part").select("p_partkey", X.title(text, F.lit("a/b/p.md")).alias("title"))


@query("SELECT p_partkey, substring(repeat(p_name || ' ', 30), 1, 200) AS description FROM part")
def readme_descriptions(spark, sf_dir):
    text = F.concat(F.lit("# Title\n\n![badge](x)\n[![b](c)](d)\n<p>\n  "), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(30)), F.lit("\nmore"))
    return table(spark, sf_dir, "part").select("p_partkey", X.readme_description(text).alias("description"))


@query("SELECT o_custkey AS k, CASE WHEN count(*) < 2 THEN '' WHEN count(DISTINCT o_orderstatus) > 1 THEN 'src' ELSE 'src/' || max(o_orderstatus) || CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN '/' || max(o_orderpriority) ELSE '' END END AS parent FROM orders GROUP BY 1")
def common_parents(spark, sf_dir):
    path = F.concat_ws("/", F.lit("src"), "o_orderstatus", "o_orderpriority", F.concat(F.col("o_orderkey").cast("string"), F.lit(".py")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(path).alias("p")).select("k", T.common_parent(F.col("p")).alias("parent"))


@query("""WITH n AS (SELECT p_partkey AS id, p_partkey - p_partkey % 10 AS parent, p_partkey % 10 AS i FROM part)
    SELECT a.id, 'T' || a.id AS name, coalesce(string_agg('m' || n.id, ',' ORDER BY n.id) FILTER (n.i BETWEEN 1 AND 5 AND n.i <> 3), '') AS fields, coalesce(string_agg('m' || n.id, ',' ORDER BY n.id) FILTER (n.i > 5), '') AS methods FROM n a LEFT JOIN n ON n.parent = a.id AND n.i > 0 WHERE a.i = 0 AND a.id % 30 <> 0 GROUP BY a.id""")
def exported_types(spark, sf_dir):
    """Every tenth part is a type, hidden if its id is divisible by 30; parts of remainder 3 are hidden fields."""
    i, k = F.col("p_partkey") % 10, F.col("p_partkey").cast("string")
    kind = F.when(i == 0, "class").when(i <= 5, "attribute").otherwise("method")
    name = F.when(i == 0, F.concat(F.when(F.col("p_partkey") % 30 == 0, "_T").otherwise("T"), k)).otherwise(F.concat(F.when(i == 3, "_m").otherwise("m"), k))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), kind.alias("node_type"), F.lit("python").alias("language"), F.when(i > 0, F.col("p_partkey") - i).alias("parent_id"), F.col("p_partkey").alias("start_line"))
    return D.public_types(nodes).select("id", "name", F.array_join("fields", ",").alias("fields"), F.array_join("methods", ",").alias("methods"))


@query("SELECT conv_id, 'B' AS heading, '### B' || chr(10) || role AS body FROM (SELECT conv_id, max(role) AS role FROM conversations GROUP BY conv_id)")
def section_bodies(spark, sf_dir):
    """The text of one section, from its heading to the next of its level or higher."""
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("role").alias("role")).select("conv_id", F.concat(F.lit("# T\n## A\nx\n### B\n"), "role", F.lit("\n## C\ny")).alias("text"))
    return P.section_bodies(docs, "conv_id", "text", "b").select("conv_id", "heading", "body")


@query("""WITH q AS (SELECT o_orderkey AS page, o_orderkey % 2 = 0 AS v, o_orderkey % 3 = 0 AS f, o_orderkey % 5 = 0 AS all_asked, o_orderkey % 7 AS w FROM orders)
    SELECT page, CASE WHEN v AND f THEN 'how-to-run,what-is' WHEN v THEN 'what-is' WHEN f THEN 'how-to-run' ELSE '' END AS answered,
    array_to_string(list_filter(['how-to-run', 'limits', 'what-is'], lambda x: NOT (x = 'what-is' AND v OR x = 'how-to-run' AND f OR x = 'limits' AND all_asked)), ',') AS missing,
    CASE WHEN v AND f THEN 'extra' WHEN v THEN 'extra,how-to-run' WHEN f THEN 'extra,what-is' ELSE 'extra,how-to-run,what-is' END AS ungrounded, 'extra' AS extra,
    CASE WHEN w IN (1, 4) THEN 'open_questions_forbidden' WHEN w = 2 THEN 'test_strategy_forbidden' WHEN w = 3 THEN 'comparison_forbidden' WHEN v AND f AND all_asked THEN 'ok' ELSE 'partial' END AS outcome FROM q""")
def coverage_gate(spark, sf_dir):
    """Answered, missing and ungrounded questions of pages, and what that comes to; some pages have sections that they mustn't."""
    o = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")), "page")  # everything below goes by page
    worse = F.element_at(F.array(*map(F.lit, ("## Other\n", "## Open Questions \n", "## test strategy\n", "## Comparison with alternatives\nx\n", "## Test Strategy\n## open questions\n", "### Open questions\n", "text ## Open questions\n"))), (F.col("page") % 7 + 1).cast("int"))
    text = F.concat(F.lit("# T\n## One\n<!-- answers: what-is -->\nSee [[node:a.b]].\n## Two\n<!-- answers: how-to-run -->\nSource: [main.go](L1)\n## Three\n<!-- answers: extra -->\nnothing\n"), worse)
    required = o.select("page", F.explode(F.when(F.col("page") % 5 == 0, F.array(F.lit("what-is"), F.lit("how-to-run"))).otherwise(F.array(*map(F.lit, ("what-is", "how-to-run", "limits"))))).alias("question"))
    one = lambda when, kind, target: o.where(when).select("page", F.lit(kind).alias("kind"), F.lit(target).alias("target"))
    docs = o.withColumn("text", text)
    # A forbidden section is found before the join, so that no text is shuffled.
    worst = docs.select("page", K.coverage_outcome(F.col("text"), F.array()).alias("worst"))
    out = K.coverage(docs, required, one("page % 2 = 0", "node", "a.b").union(one("page % 3 = 0", "file", "main.go"))).join(worst, "page")
    outcome = F.when((F.col("worst") == "ok") & (F.size("missing") > 0), "partial").otherwise(F.col("worst"))
    return out.select("page", *(F.array_join(c, ",").alias(c) for c in ("answered", "missing", "ungrounded", "extra")), outcome.alias("outcome"))


@query("SELECT o_orderkey AS page, '# T' || chr(10) || '## Keep' || chr(10) || 'a' || chr(10) || '## Last' || chr(10) || o_orderkey AS text FROM orders")
def forbidden_sections(spark, sf_dir):
    text = F.concat(F.lit("# T\n## Keep\na\n## Open Questions\nb\n### sub\nc\n## test strategy \nd\n## Last\n"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), K.without_sections(text).alias("text"))


@query("SELECT o_orderkey AS page, o_orderkey % 5 <> 4 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 4 < 3 AND (o_orderkey % 6 + o_orderkey % 3) / greatest(o_orderkey % 8, 1)::DOUBLE <= 0.5 AS allowed FROM orders")
def edits_allowed(spark, sf_dir):
    k = F.col("o_orderkey")
    reason = F.element_at(F.array(*map(F.lit, ("cited_node_content_changed", "cited_node_missing", "cited_chunk_missing", "cited_evidence_changed", "spec_changed"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("page"), K.edit_allowed(reason, k % 7 > 0, k % 11 == 0, k % 4, k % 6, k % 3, k % 8).alias("allowed"))


@query("""WITH p AS (SELECT c_nationkey AS repo, c_custkey AS pos, CASE WHEN c_custkey % 9 = 0 THEN ' ' WHEN c_custkey % 9 = 1 THEN 'Shared' ELSE 'T' || c_custkey END AS title FROM customer), k AS (SELECT min(pos) AS pos FROM p WHERE trim(title) <> '' GROUP BY lower(trim(title))), t AS (SELECT p.* FROM p JOIN k USING (pos) ORDER BY pos LIMIT 25)
    SELECT pos, title, CASE WHEN pos % 4 = 3 AND (SELECT count(*) FROM t WHERE title = 'T2') > 0 THEN 'T2' END AS parent FROM t""")
def steering_pages(spark, sf_dir):
    """Titles that are blank or repeated go; parents that are unknown or below another page are cleared."""
    k = F.col("c_custkey")
    title = F.when(k % 9 == 0, " ").when(k % 9 == 1, "Shared").otherwise(F.concat(F.lit("T"), k.cast("string")))
    parent = F.when(k % 4 == 3, "t2").when(k % 4 == 1, "Unknown")
    out = D.steering_pages(table(spark, sf_dir, "customer").select(k.alias("pos"), title.alias("title"), parent.alias("parent")))
    return out.select("pos", "title", F.when(F.col("parent").isNotNull(), F.upper("parent")).alias("parent"))


@query("WITH h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'repo_docs' ELSE 'md_collections' END AS store FROM documents) SELECT mode, doc_id FROM h, (VALUES ('code', ['code']), ('wiki', ['repo_docs']), ('mixed', ['code', 'repo_docs']), ('asked', ['md_collections', 'code'])) m(mode, stores) WHERE list_contains(stores, store)")
def retrieval_modes(spark, sf_dir):
    """The hits of the stores that each mode of retrieval reads, and of stores that are asked for by name."""
    store = F.element_at(F.array(*map(F.lit, ("code", "repo_docs", "md_collections"))), (F.col("doc_id") % 3 + 1).cast("int"))
    hits = table(spark, sf_dir, "documents").select("doc_id", store.alias("store"))
    wanted = {m: H.stores_of(H.layers_of(m)) for m in H.MODES} | {"asked": H.stores_of(H.layers_of("wiki"), ("md_collections", "code"))}
    out = None
    for mode, stores in wanted.items():
        rows = hits.where(F.col("store").isin(sorted(stores))).select(F.lit(mode).alias("mode"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH g AS (SELECT o_custkey AS repo, o_orderkey % 6 AS i FROM orders GROUP BY ALL), r AS (SELECT repo, 'Usage' AS label, 'README.md' AS path, 3::BIGINT AS line, '## Usage' || chr(10) || 'run it' AS snippet, 0 AS part FROM g WHERE i = 0
    UNION ALL SELECT repo, 'Examples', 'readme.md', 1, '# Examples', 0 FROM g WHERE i = 1 AND repo NOT IN (SELECT repo FROM g WHERE i = 0) UNION ALL SELECT repo, 'examples/a.py', 'examples/a.py', NULL, 'a.py', 1 FROM g WHERE i = 2 UNION ALL SELECT repo, 'examples/deep', 'examples/deep', NULL, 'directory examples/deep/', 1 FROM g WHERE i = 3)
    SELECT repo, label, path, line, snippet FROM r""")
def use_cases(spark, sf_dir):
    i = (F.col("i") + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), i)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 6).alias("i")).distinct()
    files = rows.select("repo", pick("README.md", "readme.md", "examples/a.py", "examples/deep/b.py", "examples/.hidden", "src/x.md").alias("path"), pick("# T\nintro\n## Usage\nrun it\n## Next\nno", "# Examples", "x", "x", "x", "# Usage\n").alias("content"))
    return D.use_cases(files)


@query("""WITH n AS (SELECT p_partkey AS k, p_partkey % 8 AS i FROM part) SELECT 'q' || lpad(k::VARCHAR, 8, '0') AS qualified_name FROM n WHERE i IN (0, 1, 2, 4) ORDER BY 1 LIMIT 30""")
def error_types(spark, sf_dir):
    i = (F.col("p_partkey") % 8 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), i)
    name = pick("ParseError", "BadException", "Thing", "_HiddenError", "IoError", "Error", "ParseError", "Plain")
    kind, language = pick("struct", "class", "class", "class", "class", "struct", "interface", "class"), pick("go", "python", "python", "python", "typescript", "go", "go", "python")
    bases = F.when(i == 3, F.array(F.lit("lib.BaseError"))).otherwise(F.array().cast("array<string>"))
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("qualified_name"), name.alias("name"), kind.alias("node_type"), language.alias("language"), bases.alias("bases"))
    return D.error_types(nodes).select("qualified_name")


#: Lines two to four of each document, made some 25 kB long by repetition where the id is divisible by 3, up to 20,000 bytes on a character's edge.
_READS = """WITH d AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || repeat(replace(text, chr(10), ' ') || 'é', (1 + 25000 // greatest(1, octet_length(encode(text))))::INT) ELSE text END AS text FROM documents WHERE NOT contains(text, chr(0))),
    l AS (SELECT path, string_split(text, chr(10)) AS l FROM d), b AS (SELECT path, l, array_to_string(l[2:4], chr(10)) AS body FROM l), e AS (SELECT *, encode(body) AS raw, octet_length(encode(body)) AS n FROM b),
    c AS (SELECT *, CASE WHEN n <= 20000 THEN n ELSE 20000 - (CASE WHEN NOT regexp_matches(hex(array_slice(raw, 20001, 20001)), '^[89AB]') THEN 0 WHEN NOT regexp_matches(hex(array_slice(raw, 20000, 20000)), '^[89AB]') THEN 1 WHEN NOT regexp_matches(hex(array_slice(raw, 19999, 19999)), '^[89AB]') THEN 2 ELSE 3 END) END AS z FROM e)
    SELECT path, decode(array_slice(raw, 1, z)) AS body, n > 20000 OR len(l) > 4 AS truncated FROM c"""


@query(_READS)
def checkout_reads(spark, sf_dir):
    """Reads that end at their lines, and reads that the cap of bytes cuts."""
    text = F.col("text")
    long = F.concat(F.lit("x\n"), F.expr("repeat(concat(replace(text, '\n', ' '), 'é'), cast(1 + 25000 div greatest(1, octet_length(text)) as int))"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, long).otherwise(text).alias("content"))
    return D.read_text(docs, 1, 3)


@query("SELECT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages WHERE regexp_matches(url, '://[^/?#]*/en/[^?#]*') ORDER BY 1 LIMIT 200")
def checkout_listing(spark, sf_dir):
    return D.list_files(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")), "[^/]*/en/.*")


@query("""WITH c AS (SELECT o_orderkey AS k, ['A', 'M', 'D', 'R'][o_orderkey % 4 + 1] AS kind FROM orders) SELECT 'n' || k || '.ts' AS path, '2-ingest' AS step FROM c WHERE kind <> 'D' UNION ALL SELECT 'n' || k || '.ts', '1-delete' FROM c WHERE kind = 'D' UNION ALL SELECT 'o' || k || '.go', '1-delete' FROM c WHERE kind = 'R'""")
def change_steps(spark, sf_dir):
    """Renames change the language: the old path is deleted, the new one read."""
    k = F.col("o_orderkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, "AMDR")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    feed = table(spark, sf_dir, "orders").select(kind.alias("kind"), F.concat(F.lit("n"), k, F.lit(".ts")).alias("path"), F.when(kind == "R", F.concat(F.lit("o"), k, F.lit(".go"))).alias("old_path"))
    return I.plan_changes(feed)


@query("SELECT 'plain' AS feed, false AS full UNION ALL SELECT 'module', true UNION ALL SELECT 'none', false UNION ALL SELECT 'failed', true")
def full_walks(spark, sf_dir):
    """A feed that doesn't touch the module file, one that does, one without changes, and one that couldn't be read."""
    feed = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(None).cast("string").alias("old_path"))
    module = feed.unionByName(feed.limit(1).select("path", F.lit("go.mod").alias("old_path")))
    out = None
    for name, rows, failed in (("plain", feed, False), ("module", module, False), ("none", feed.where(F.lit(False)), False), ("failed", feed.where(F.lit(False)), True)):
        one = I.needs_full_walk(rows, failed=failed).select(F.lit(name).alias("feed"), "full")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderkey AS doc, l_linenumber AS chunk, CASE WHEN o_orderkey % 4 < 2 THEN 'new' ELSE 'old' END AS version FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 3""")
def replaced_chunks(spark, sf_dir):
    """Documents are inserted (0), updated (1), kept (2) or deleted (3); inserted ones had no chunks."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk"))
    action = F.element_at(F.array(*map(F.lit, ("insert", "update", "keep", "delete"))), (F.col("doc") % 4 + 1).cast("int"))
    documents = lines.select("doc").distinct().withColumn("action", action)
    return I.replace_children(lines.where("doc % 4 != 0").withColumn("version", F.lit("old")), lines.where("doc % 4 != 3").withColumn("version", F.lit("new")), documents, "doc")


@query("""SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS included FROM part""")
def go_build_variants(spark, sf_dir):
    """For linux on amd64 without cgo: names and constraints; a tag of one's own is unknown."""
    i = (F.col("p_partkey") % 8 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), i)
    name = pick("a", "a_windows", "a_linux_amd64_test", "a", "a", "a_b", "a", "a_cgo")
    head = pick("", "", "", "//go:build custom && linux", "//go:build !unix || (custom && arm64)", "//go:build go1.20 && !cgo", "// note\n\n//go:build custom || linux", "//go:build linux")
    files = table(spark, sf_dir, "part").select(F.concat(name, F.lit(".go")).alias("file"), F.col("p_partkey").cast("string").alias("k"), F.concat(head, F.lit("\npackage a\n//go:build windows\n")).alias("content"))
    out = C.go_files(files.select(F.concat_ws("/", "k", "file").alias("path"), "content"))
    return out.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("k"), "included")


@query("SELECT doc_id, 0::BIGINT AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE '' END AS heading, CASE WHEN doc_id % 2 = 0 THEN '# T' || chr(10) ELSE '' END || 'body ' || doc_id || repeat(' x', 30) AS content FROM documents UNION ALL SELECT doc_id, 1, 'T', '## Long' || chr(10) || repeat('word ', 794) || 'word' FROM documents WHERE doc_id % 2 = 0")
def character_chunks(spark, sf_dir):
    """A short document is one chunk; a long section is a chunk of its own, below the common heading."""
    even = F.col("doc_id") % 2 == 0
    text = F.concat(F.when(even, "# T\n").otherwise(""), F.lit("body "), F.col("doc_id").cast("string"), F.repeat(F.lit(" x"), F.lit(30)), F.when(even, F.concat(F.lit("\n## Long\n"), F.rtrim(F.repeat(F.lit("word "), F.lit(795))))).otherwise(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return X.chunked(docs, "doc_id", "text").select("doc_id", "chunk_index", F.get("heading_path", F.lit(0)).alias("h"), "content").select("doc_id", "chunk_index", F.coalesce("h", F.lit("")).alias("heading"), "content")


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events")
def appended_log(spark, sf_dir):
    """A stream of events appended to a log table batch by batch."""
    from lodestone.plans.tables import instants
    from lodestone.streaming import usage as U

    path = new_path(spark, "log")
    stream = instants(U.read_stream(spark, f"{sf_dir}/events.parquet"))
    stream.writeStream.foreachBatch(lambda batch, _: U.append(batch, f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


_BUNDLE = """WITH g AS (SELECT p_partkey AS id, p_name AS text, len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: t = 'widget')) AS n FROM part), c AS (SELECT id, text, row_number() OVER (ORDER BY n DESC, id) AS rank FROM g WHERE n > 0 QUALIFY rank <= 300),
    d AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t = 'license')) DESC, doc_id) AS rank FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'license')),
    u AS ((SELECT 'code' AS part, id, text FROM c ORDER BY round(1.0 / (60 + rank), 12) DESC, id::VARCHAR LIMIT 12) UNION ALL (SELECT 'docs', id, text FROM d ORDER BY rank LIMIT 6)
    UNION ALL (SELECT 'pivot', id, NULL FROM c ORDER BY round(1.0 / (60 + rank), 12) DESC, id::VARCHAR LIMIT 5) UNION ALL (SELECT 'section docs', id, text FROM d ORDER BY rank LIMIT 4))
    SELECT part, id::VARCHAR AS id, CASE WHEN length(text) > 1200 THEN substring(text, 1, 1200) || '…' ELSE text END AS snippet FROM u"""


@query(_BUNDLE)
def page_bundle(spark, sf_dir):
    """What a page and one of its sections are written from, with the texts of the hits up to their cap."""
    from lodestone.operators import token_index as TI
    from lodestone.plans.tables import calls, parts_as_nodes

    parts, texts = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    code = H.Store(parts, "p_partkey", {"A": "p_name"}, tokens=TI.token_index(parts, "p_partkey", {"A": "p_name"}))
    docs = H.Store(texts, "doc_id", {"D": "text"}, tokens=TI.token_index(texts, "doc_id"))
    graph = calls(spark, sf_dir), parts_as_nodes(spark, sf_dir)
    page = H.page_bundle(code, docs, *graph, "widget", None)
    docs_only = H.page_bundle(code, docs, *graph, "license", None, k_pivot=0)["docs"]
    section = H.section_bundle(code, docs, *graph, "::", "license", None)["docs"]
    rows = [H.with_snippets(page["code"], parts, "p_partkey", "p_name").select(F.lit("code").alias("part"), "id", "snippet")]
    rows += [H.with_snippets(hits, texts, "doc_id", "text").select(F.lit(n).alias("part"), "id", "snippet") for n, hits in (("docs", docs_only), ("section docs", section))]
    rows.append(page["pivot"].select(F.lit("pivot").alias("part"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("snippet")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
