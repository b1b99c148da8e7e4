"""Queries over code nodes, listings and memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import access as A
from lodestone.operators import gram_index as GI
from lodestone.operators import graph as G
from lodestone.operators import incremental as I
from lodestone.operators import retrieval as R
from lodestone.operators import search as S
from lodestone.plans.tables import EDGES_SQL, NODES_SQL, calls, parts_as_nodes, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL}), {sql}" if sql.startswith("x AS") else sql
        return f

    return add


#: Every tenth part is the parent of the nine after it.
_PARENT = "CASE WHEN id % 10 <> 0 THEN id - id % 10 END"
_LAST = "regexp_extract(qualified_name, '[^.]*$')"
_RESOLVE = f"""ex AS (SELECT qualified_name AS target, min(id) AS exact FROM nodes GROUP BY 1), sf AS (SELECT id, name AS target FROM nodes UNION SELECT id, {_LAST} FROM nodes), so AS (SELECT target, min(id) AS sole FROM sf GROUP BY target HAVING count(*) = 1)"""


def _with_parents(spark, sf_dir):
    return parts_as_nodes(spark, sf_dir).withColumn("parent_id", F.when(F.col("id") % 10 != 0, F.col("id") - F.col("id") % 10))


@query("x AS (SELECT 1) SELECT count(*) AS total, count_if(node_type IN ('module', 'class', 'struct', 'interface') AND contains(lower(name), 'red'))::BIGINT AS matched, least(count_if(node_type IN ('module', 'class', 'struct', 'interface') AND contains(lower(name), 'red')), 50)::BIGINT AS returned, 'go,python' AS languages FROM nodes")
def graph_listing_stats(spark, sf_dir):
    out = G.listing_stats(parts_as_nodes(spark, sf_dir), 50, view="architecture", name="Red")
    return out.select("total", "matched", F.col("returned").cast("long").alias("returned"), F.array_join("languages", ",").alias("languages"))


@query(f"""x AS (SELECT id, {_LAST} AS inherits, (SELECT count(*) FROM nodes) AS total FROM nodes), {_RESOLVE},
    told AS (SELECT id AS src, 'inherits' AS type, inherits AS target FROM x UNION SELECT id, 'imports', qualified_name FROM nodes WHERE id % 2 = 0)
    SELECT {_PARENT} AS src, id AS dst, 'declares' AS type FROM nodes WHERE id % 10 <> 0 AND id - id % 10 IN (SELECT id FROM nodes) UNION SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)
    UNION SELECT src, coalesce(exact, sole) AS dst, type FROM told LEFT JOIN ex USING (target) LEFT JOIN so USING (target) WHERE coalesce(exact, sole) IS NOT NULL""")
def edges_synthesised(spark, sf_dir):
    callees = calls(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("callees"))
    last = F.array(F.regexp_extract("qualified_name", "[^.]*$", 0))
    none = F.array().cast("array<string>")
    metadata = F.create_map(F.lit("inherits"), last, F.lit("imports"), F.when(F.col("id") % 2 == 0, F.array("qualified_name")).otherwise(none))
    nodes = _with_parents(spark, sf_dir).join(callees, "id", "left").withColumns({"callees": F.coalesce("callees", F.array().cast("array<bigint>")), "metadata": metadata})
    return G.synthesised(nodes)


@query("x AS (SELECT 1) SELECT id, name FROM nodes WHERE qualified_name = 'brand17.red_widget'")
def node_by_qualified_name(spark, sf_dir):
    return G.by_qualified_name(parts_as_nodes(spark, sf_dir), "brand17.red_widget").select("id", "name")


@query(f"x AS (SELECT {_PARENT} AS src, id AS dst, 'declares' AS type FROM nodes WHERE id % 10 <> 0 UNION ALL SELECT * FROM edges) SELECT src, dst, type FROM x JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE type <> 'declares' AND a.node_type IN ('function', 'class', 'method', 'interface', 'struct', 'module') AND b.node_type IN ('function', 'class', 'method', 'interface', 'struct', 'module')")
def displayable_edges(spark, sf_dir):
    nodes = _with_parents(spark, sf_dir)
    declared = nodes.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("declares").alias("type"))
    return G.displayable(nodes, calls(spark, sf_dir).select("src", "dst", "type").union(declared))[1]


@query(f"""x AS (SELECT id, name, {_PARENT} AS parent FROM nodes WHERE id % 20 = 0), far AS (SELECT id, {_PARENT} AS parent FROM nodes),
    a AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS callers FROM edges GROUP BY dst), b AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS callees FROM edges GROUP BY src), m AS (SELECT parent AS id, string_agg(id, ',' ORDER BY id) AS members FROM far WHERE parent IS NOT NULL GROUP BY parent)
    SELECT id, name, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, coalesce(members, '') AS members, parent FROM x LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN m USING (id)""")
def neighbourhood_batch(spark, sf_dir):
    nodes = _with_parents(spark, sf_dir)
    out = G.neighbourhoods(nodes.where("id % 20 = 0"), nodes, calls(spark, sf_dir))
    return out.select("id", "name", *(F.array_join(c, ",").alias(c) for c in ("callers", "callees", "members")), "parent")


@query(f"""x AS (SELECT src, 'calls' AS type, b.qualified_name AS target, CASE WHEN dst % 3 <> 0 THEN dst END AS dst FROM edges JOIN nodes b ON b.id = dst), d AS (SELECT DISTINCT * FROM x), g AS (SELECT DISTINCT qualified_name AS target FROM nodes WHERE id % 2 = 0), e AS (SELECT qualified_name AS target, min(id) AS exact FROM nodes GROUP BY 1)
    SELECT src, type, target, dst FROM d WHERE NOT (dst IS NULL AND target IN (FROM g)) UNION SELECT src, type, target, exact FROM d JOIN e USING (target) WHERE dst IS NULL AND target IN (FROM g)""")
def edges_reresolved(spark, sf_dir):
    """A third of the call edges dangle; the nodes of even id have changed."""
    nodes = parts_as_nodes(spark, sf_dir)
    edges = calls(spark, sf_dir).join(nodes.select(F.col("id").alias("dst"), F.col("qualified_name").alias("target")), "dst").select("src", "type", "target", F.when(F.col("dst") % 3 != 0, F.col("dst")).alias("dst")).distinct()
    return G.reresolved(edges, nodes, nodes.where("id % 2 = 0")).distinct()


@query("""x AS (SELECT DISTINCT src, b.qualified_name AS target, CASE WHEN dst % 3 <> 0 THEN dst END AS dst FROM edges JOIN nodes b ON b.id = dst)
    SELECT src, count(dst) AS resolved, count(*) - count(dst) AS unresolved, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (dst IS NULL), '') AS unresolved_calls FROM x GROUP BY src""")
def call_counters(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    edges = calls(spark, sf_dir).join(nodes.select(F.col("id").alias("dst"), F.col("qualified_name").alias("target")), "dst").select("src", "type", "target", F.when(F.col("dst") % 3 != 0, F.col("dst")).alias("dst")).distinct()
    return G.call_counts(edges).withColumn("unresolved_calls", F.array_join("unresolved_calls", ","))


@query("WITH n AS (SELECT greatest(10, least(500, floor(0.2 * count(*))))::BIGINT AS k FROM part) SELECT id, rank FROM (SELECT p_partkey AS id, p_retailprice AS rank, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part), n WHERE place <= k")
def importance_top(spark, sf_dir):
    return G.most_important(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank")))


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'class' ELSE 'method' END AS node_type, 'm.C' || (p_partkey // 10) || CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 9 THEN '.inner.f' ELSE '.f' || p_partkey END AS qualified_name FROM part)
    SELECT a.id, CASE WHEN a.node_type = 'method' THEN b.id END AS parent_id FROM m a LEFT JOIN m b ON b.qualified_name = regexp_replace(a.qualified_name, '\\.[^.]*$', '')""")
def methods_reparented(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    tail = F.when(F.col("id") % 10 == 0, "").when(F.col("id") % 10 == 9, ".inner.f").otherwise(F.concat(F.lit(".f"), F.col("id").cast("string")))
    nodes = p.select("id", F.when(F.col("id") % 10 == 0, "class").otherwise("method").alias("node_type"), F.concat(F.lit("m.C"), F.expr("id div 10").cast("string"), tail).alias("qualified_name"), F.lit(None).cast("long").alias("parent_id"))
    return G.reparented(nodes).select("id", "parent_id")


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w)::BIGINT + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""WITH l AS (SELECT p_partkey AS id, len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: t = 'widget')) * 1.0 AS s FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget')),
    g AS (SELECT p_partkey AS id, {_GRAMS.format('p_name')} AS g, {_GRAMS.format("'widget'")} AS q FROM part), y AS (SELECT id, len(list_intersect(g, q)) * 1.0 / (len(g) + len(q) - len(list_intersect(g, q))) AS s FROM g WHERE len(list_intersect(g, q)) * 1.0 / (len(g) + len(q) - len(list_intersect(g, q))) >= 0.3),
    r AS (SELECT id, 'lexical' AS stream, row_number() OVER (ORDER BY s DESC, id) AS rank FROM l QUALIFY rank <= 20 UNION ALL SELECT id, 'symbol', row_number() OVER (ORDER BY s DESC, id) AS rank FROM y QUALIFY rank <= 20)
    SELECT id::VARCHAR AS id, round(sum(1.0 / (60 + rank))::DOUBLE, 9) AS score FROM r GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id::VARCHAR LIMIT 20""")
def symbol_exact(spark, sf_dir):
    out = R.symbol_exact(table(spark, sf_dir, "part"), "widget", 20, "p_partkey", "p_name", {"A": "p_name"})
    return out.select("id", F.round("score", 9).alias("score"))


@query("""WITH c AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100), s AS (SELECT id, round(len(regexp_extract_all(lower(text), 'the')) / (length(text) + 1.0), 12)::DOUBLE AS score FROM c)
    SELECT id, score, score AS rerank_score FROM s ORDER BY score DESC, id LIMIT 12""")
def rerank_scored(spark, sf_dir):
    """A scorer in place of a model: how often the query occurs for each character."""
    candidates = R.top(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("text").alias("content")), 100)
    density = lambda q, c: F.round(F.regexp_count(F.lower(c), q) / (F.length(c) + 1.0), 12)
    return R.reranked(candidates, "the", 12, density).select("id", "score", "rerank_score")


@query("SELECT doc_id AS id, n_chars::DOUBLE AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def rerank_none(spark, sf_dir):
    candidates = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("text").alias("content"))
    return R.reranked(candidates, "the", 12).select("id", "score")


_DOC = "SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path, CASE WHEN page_id % 5 > 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages"


@query(f"SELECT page_id FROM ({_DOC}) WHERE contains(lower(path), 'blog') OR contains(lower(coalesce(title, '')), 'blog')")
def doc_search_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.when(F.col("page_id") % 5 > 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    names = docs.select("page_id", F.concat_ws(" ", "path", "title").alias("names"))
    return GI.holding(GI.gram_index(names, "page_id", "names"), docs, "Blog", "page_id", "path", "title").select("page_id")


@query("SELECT c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE (contains(lower(c_name), '7') OR contains(lower(n_name), '7') OR contains(lower(c_mktsegment), '7')) AND c_mktsegment = 'BUILDING'")
def repo_search(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("host"))
    repos = table(spark, sf_dir, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("id"), "host", F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("git_url"), F.col("c_mktsegment").alias("status"))
    return S.repositories(repos, "7", "BUILDING").select("id")


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("repo_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 4 > 0 WHERE contains(lower(coalesce(c_name, '')), '77') OR contains(lower(o_orderpriority), '77')")
def jobs_with_repositories(spark, sf_dir):
    repos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return S.jobs(_jobs(spark, sf_dir), repos, "77").select("id")


@query("SELECT o_orderkey AS id, c_name AS collection FROM orders JOIN customer ON c_custkey = o_custkey WHERE (c_nationkey = 3 OR c_mktsegment = 'BUILDING') AND o_orderkey % 4 > 0 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def visible_jobs(spark, sf_dir):
    collections = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner"), F.when(F.col("c_mktsegment") == "BUILDING", "public").otherwise("private").alias("visibility"))
    return S.visible_jobs(_jobs(spark, sf_dir).withColumnRenamed("repo_id", "collection_id"), collections, 3, "owner", "F").select("id", "collection")


@query("SELECT c_name AS email, count(o_orderkey) AS query_count, row_number() OVER (ORDER BY count(o_orderkey) DESC, lower(c_name), c_name) AS place FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name")
def users_by_usage(spark, sf_dir):
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("query_count"))
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("email")).join(used, "c_custkey", "left").select("email", F.coalesce("query_count", F.lit(0)).alias("query_count"))
    return S.by_usage(users)


@query("""WITH f AS (SELECT o_custkey AS repo, ['docs/README.md', 'readme.rst', 'src/readme.md', 'README', 'main.go'][o_orderkey % 5 + 1] AS path FROM orders)
    SELECT repo, path FROM (SELECT DISTINCT *, list_position(['readme.md', 'readme.rst', 'readme.txt', 'readme'], lower(regexp_extract(path, '[^/]*$')))  AS way FROM f) WHERE way IS NOT NULL AND way > 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY way, len(string_split(path, '/')), path) = 1""")
def first_readmes(spark, sf_dir):
    paths = F.array(*map(F.lit, ("docs/README.md", "readme.rst", "src/readme.md", "README", "main.go")))
    return S.first_readme(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.element_at(paths, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("path")))


@query(r"SELECT lang, coalesce(sum(len(regexp_extract_all(text, '\b[A-Za-z_][A-Za-z0-9_]*\(\)'))), 0)::BIGINT AS mentions FROM documents GROUP BY lang")
def mention_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.regexp_extract_all("text", F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\(\)"), F.lit(0)).alias("mentions"))
    return S.mention_counts(rows, "lang", "mentions")


@query("SELECT n_nationkey AS group_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS members, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS grants FROM nation")
def group_counts(spark, sf_dir):
    members = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("group_id"))
    return S.group_counts(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id")), members, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id")))


@query("SELECT count(*) = 0 AS none_left FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_custkey % 2 = 1")
def last_admin_guard(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"), (F.col("c_acctbal") > 0).alias("active"))
    return S.last_admins(users, users.where("id % 2 = 0"))


@query("SELECT o_orderpriority AS slot, count_if(o_custkey % 3 = 0)::BIGINT AS unresolved FROM orders GROUP BY 1")
def unresolved_links(spark, sf_dir):
    return S.unresolved_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("slot"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("target")), "slot", "target")


@query("WITH x AS (SELECT p_partkey AS id, p_name AS name, label, CASE WHEN p_size > 25 THEN p_type END AS summary FROM part JOIN embeddings ON vec_id = p_partkey) SELECT id, name, label, summary FROM x")
def embedded_nodes_with_summaries(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir).select("id", "name")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    summaries = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("summary"))
    return S.summarised(nodes, vectors, summaries).join(vectors.select("id", "label"), "id").select("id", "name", "label", "summary")


@query(f"""x AS (SELECT name, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS s, id FROM nodes JOIN (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) USING (id), (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0)) SELECT id, name, round(s, 6) AS score FROM x ORDER BY s DESC, id LIMIT 25""")
def nearest_nodes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    probe = [float(x) for x in vectors.where("vec_id = 0").select("embedding").first()[0]]
    nodes = parts_as_nodes(spark, sf_dir).select(F.col("id").alias("vec_id"), "name")
    hits = R.vector_stream(vectors.join(nodes.select("vec_id"), "vec_id", "left_semi"), probe, 25)
    return hits.join(nodes.withColumnRenamed("vec_id", "id"), "id").select("id", "name", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT l_partkey AS node_id, l_orderkey AS chunk_id FROM lineitem WHERE l_partkey % 20 = 0), c AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id FROM orders), n AS (SELECT node_id, doc_id, c_name AS path, count(*) AS n FROM m JOIN c USING (chunk_id) JOIN customer ON c_custkey = doc_id GROUP BY ALL)
    SELECT node_id, doc_id, path, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, doc_id) AS place FROM n QUALIFY place <= 3""")
def linked_documents(spark, sf_dir):
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("chunk_id"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("path"))
    return S.linked_documents(mentions.where("node_id % 20 = 0"), mentions, chunks, docs)


@query("""WITH m AS (SELECT user_id, event_id % 25 AS group_id, CASE WHEN event_id % 3 = 0 THEN 'oidc' ELSE 'manual' END AS source, CASE WHEN event_id % 3 = 0 THEN (event_id % 25) % 7 END AS provider_id FROM events), j AS (SELECT user_id, n_name AS group_name, source, r_name AS provider, group_id FROM m JOIN nation ON n_nationkey = group_id LEFT JOIN region ON r_regionkey = provider_id)
    SELECT user_id, group_name, source, provider FROM j QUALIFY row_number() OVER (PARTITION BY user_id, group_id ORDER BY CASE WHEN source = 'oidc' THEN 0 ELSE 1 END, provider NULLS FIRST) = 1""")
def membership_with_providers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("group_id", F.col("event_id") % 25)
    synced = F.col("event_id") % 3 == 0
    members = e.select("user_id", "group_id", F.when(synced, "oidc").otherwise("manual").alias("source"), F.when(synced, F.col("group_id") % 7).alias("provider_id"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    return S.group_sources(members, groups, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("provider_id"), F.col("r_name").alias("name")))


@query("x AS (SELECT id FROM nodes WHERE id % 50 = 0) SELECT DISTINCT id FROM (SELECT dst AS id FROM edges WHERE src IN (FROM x) UNION ALL SELECT src FROM edges WHERE dst IN (FROM x)) WHERE id NOT IN (FROM x)")
def peers_of_deleted(spark, sf_dir):
    return I.peers_to_refresh(calls(spark, sf_dir), parts_as_nodes(spark, sf_dir).where("id % 50 = 0"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 1 OR p_partkey % 4 = 2 OR (p_partkey % 4 = 3 AND p_size % 2 = 0)")
def embeddings_to_refresh(spark, sf_dir):
    """Vectors are missing (1), of another model (2), or of another content where the size is even (3)."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("content_hash"), F.lit("m2").alias("model"))
    odd = F.when((F.col("p_partkey") % 4 == 3) & (F.col("p_size") % 2 == 0), "x").otherwise("")
    old = p.where("p_partkey % 4 != 1").select(F.col("p_partkey").alias("id"), F.sha2(F.concat("p_name", odd), 256).alias("content_hash"), F.when(F.col("p_partkey") % 4 == 2, "m1").otherwise("m2").alias("model"))
    return I.embed_again(rows, old, "id", ["content_hash", "model"]).select("id")


@query("SELECT 'lines' AS child, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 10 <> 3")
def purge_owners(spark, sf_dir):
    tables = {"lines": table(spark, sf_dir, "lineitem"), "orders": table(spark, sf_dir, "orders")}
    doomed = tables["orders"].where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("id"))
    left = I.purge(tables, doomed, {"lines": "l_orderkey", "orders": "o_orderkey"}, "id")
    counts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("child"), "n") for n in tables]
    return counts[0].unionByName(counts[1])


@query("WITH k AS (SELECT user_id, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_id % 3 = 0), '') AS now, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_id % 3 = 1) AS before FROM events GROUP BY user_id) SELECT user_id FROM k WHERE now = before")
def plans_reused(spark, sf_dir):
    """Plans whose inputs, the kinds of a third of a user's events, are those of another third."""
    from lodestone.functions.keys import fingerprint

    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 3).alias("third")).distinct()
    kinds = lambda n: F.collect_set(F.when(F.col("third") == n, F.col("event_type")))
    sets = e.groupBy("user_id").agg(kinds(0).alias("now"), kinds(1).alias("before"))
    now = sets.select("user_id", F.lit("v1").alias("schema"), fingerprint(F.col("now")).alias("inputs"))
    old = sets.where(F.size("before") > 0).select("user_id", F.lit("v1").alias("schema"), fingerprint(F.col("before")).alias("inputs"))
    return now.join(old, ["user_id", "schema", "inputs"], "left_semi").select("user_id")


@query("SELECT unnest([3, 1, 7])::BIGINT AS id, unnest([0, 1, 2])::BIGINT AS pos")
def lookup_in_given_order(spark, sf_dir):
    return A.in_given_order([3, 1, 7, 10**9], table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id").select("id", "pos")


@query("x AS (SELECT 'caller' AS direction, src AS id FROM edges WHERE dst = 12 UNION SELECT 'callee', dst FROM edges WHERE src = 12) SELECT * FROM x")
def seed_neighbours(spark, sf_dir):
    from lodestone.sources.shared import stored

    edges = stored(calls(spark, sf_dir), "calls")
    return G.seed_neighbours(G.bfs(edges, spark.createDataFrame([(12,)], "id long"), 1, "both"), edges, 12)
