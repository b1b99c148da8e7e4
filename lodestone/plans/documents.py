"""Queries over document trees, citations and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.operators import clusters
from lodestone.operators import documents as D
from lodestone.plans.tables import EDGES_SQL, NODES_SQL, calls, parts_as_nodes, spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PATHS = "SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))


@query(f"""WITH p AS ({_PATHS}), s AS (SELECT DISTINCT path, string_split(path, '/') AS w FROM p), d AS (SELECT DISTINCT array_to_string(w[1:k], '/') AS path FROM (SELECT w, unnest(range(1, len(w))) AS k FROM s)),
    a AS (SELECT path, false AS is_dir FROM s UNION ALL SELECT path, true FROM d), b AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM a)
    SELECT path, parent, is_dir, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN NOT is_dir AND lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')) IN ('readme', 'index', 'overview') THEN 0 WHEN is_dir THEN 1 ELSE 2 END, lower(path), path) - 1 AS sort_order FROM b""")
def docs_tree(spark, sf_dir):
    return D.docs_tree(_paths(spark, sf_dir).select("path"))


@query(f"""WITH p AS (SELECT page_id, 'docs/' || regexp_extract(path, '/(.*)$', 1) AS path FROM ({_PATHS})), s AS (SELECT *, substring(trim(regexp_replace(lower(regexp_replace(regexp_replace(path, '^docs/', ''), '\\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS slug FROM p)
    SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY path, page_id) > 1 THEN slug || '-' || right(page_id::VARCHAR, 4) ELSE slug END AS slug FROM s""")
def doc_slugs(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("page_id", F.concat(F.lit("docs/"), F.regexp_extract("path", "/(.*)$", 1)).alias("path"))
    return D.slugs(rows, "page_id", "path")


@query("SELECT n_name AS slug, CASE WHEN p IN (SELECT n_name FROM nation) AND p <> n_name THEN p ELSE 'none' END AS parent FROM (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'FRANCE' ELSE 'NOWHERE' END AS p FROM nation)")
def page_tree_roots(spark, sf_dir):
    parent = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, "FRANCE").otherwise("NOWHERE")
    out = D.page_tree(table(spark, sf_dir, "nation").select(F.col("n_name").alias("slug"), parent.alias("parent")), "slug", "parent")
    return out.withColumn("parent", F.coalesce("parent", F.lit("none")))


@query(f"""WITH n AS ({NODES_SQL}), c AS (SELECT o_orderkey AS page, 'node' AS kind, qualified_name AS target FROM orders JOIN n ON n.id = o_custkey UNION SELECT o_orderkey, 'doc', o_orderpriority FROM orders)
    SELECT page, kind, target, coalesce(CASE WHEN kind = 'node' THEN r.id WHEN target = '1-URGENT' THEN '77' END, '?') AS ref FROM c LEFT JOIN (SELECT qualified_name, min(id::VARCHAR) AS id FROM n GROUP BY 1) r ON qualified_name = target AND kind = 'node'""")
def citation_resolution(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").join(nodes.select(F.col("id").alias("o_custkey"), "qualified_name"), "o_custkey", "left")
    mark = lambda kind, c: F.concat(F.lit(f"[[{kind}:"), c, F.lit("#top]]" if kind == "doc" else "]]"))
    text = F.concat_ws(" ", mark("node", F.col("qualified_name")), mark("doc", F.col("o_orderpriority")), mark("doc", F.col("o_orderpriority")))
    cited = D.citations(orders.select(F.col("o_orderkey").alias("page"), text.alias("text")), "page", "text")
    docs = spark.createDataFrame([("77", "1-URGENT")], "id string, path string")
    out = D.resolve_citations(cited, nodes, docs)
    return out.select("page", "kind", F.split_part("target", F.lit("#"), F.lit(1)).alias("target"), F.coalesce("ref", F.lit("?")).alias("ref"))


@query("WITH old AS (SELECT p_partkey AS id, p_name AS q FROM part), live AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 100000 ELSE p_partkey END AS id, p_name AS q FROM part WHERE p_partkey % 5 <> 0) SELECT DISTINCT l_orderkey AS page, l_partkey AS node_id, coalesce(a.id, b.first, -1) AS new_id FROM lineitem LEFT JOIN live a ON a.id = l_partkey LEFT JOIN (SELECT o.id, min(v.id) AS first FROM live v JOIN old o USING (q) GROUP BY o.id) b ON b.id = l_partkey")
def citation_repair(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("qualified_name"))
    live = part.where("p_partkey % 5 != 0").select(F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey") + 100000).otherwise(F.col("p_partkey")).alias("id"), F.col("p_name").alias("qualified_name"))
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("node_id")).distinct()
    return D.repair(cited, old, live).withColumn("new_id", F.coalesce("new_id", F.lit(-1)))


#: Documents as pages: a title, a fence, a source line, a comment, links, and by the id up to four sections and a second fence around parts of their text.
_PAGES = """SELECT doc_id, '# Page ' || doc_id || chr(10) || '```py' || chr(10) || 'code ' || lang || chr(10) || '```' || chr(10) || coalesce(text, '') || ' see [the **' || source || '**](http://x/' || doc_id || ').' || chr(10) || '- Sources: a.py, b.py' || chr(10) || '<!-- note' || chr(10) || 'more -->tail'
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '~~~' || chr(10) || '## no' || chr(10) || '~~~' ELSE '' END || array_to_string(list_transform(range(1, doc_id % 5 + 1), lambda k: chr(10) || '## Part ' || k || chr(10) || 'words of ' || k), '') AS text FROM documents"""
_LEAD = f"""WITH p AS ({_PAGES}), f AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?ms)^\\s*```.*?^\\s*```[^\\n]*$', '', 'g'), '(?ms)^\\s*~~~.*?^\\s*~~~[^\\n]*$', '', 'g') AS t FROM p),
    s AS (SELECT doc_id, array_to_string(string_split(chr(10) || t, chr(10) || '## ')[1:4], chr(10) || '## ') AS t FROM f),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#{{1,6}}\\s.*$', '', 'g'), '(?im)^\\W*sources?:.*$', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS t FROM s),
    w AS (SELECT doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS w FROM c)
    SELECT doc_id, CASE WHEN length(w) <= MOST THEN w ELSE rtrim(regexp_replace(substring(w, 1, MOST), '\\s+\\S*$', '')) || '…' END AS lead FROM w"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_LEAD.replace('MOST', str(n))})" for n in (120, 10_000_000)))
def lead_prose(spark, sf_dir):
    """Short leads, and whole ones, of pages with titles, fences, comments, links, source lines and several sections."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    parts = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 5), lambda i: F.when(i > 0, F.concat(F.lit("\n## Part "), i.cast("string"), F.lit("\nwords of "), i.cast("string")))), "")
    page = F.concat(F.lit("# Page "), k.cast("string"), F.lit("\n```py\ncode "), "lang", F.lit("\n```\n"), text, F.lit(" see [the **"), "source", F.lit("**](http://x/"), k.cast("string"), F.lit(").\n- Sources: a.py, b.py\n<!-- note\nmore -->tail"), F.when(k % 3 == 0, "\n~~~\n## no\n~~~").otherwise(""), parts)
    pages = table(spark, sf_dir, "documents").select("doc_id", page.alias("page"))
    short, whole = (pages.select("doc_id", D.lead(F.col("page"), n).alias("lead")) for n in (120, 10_000_000))
    return short.unionByName(whole)


#: One project folder for each customer, with a requirements file, a Go module, a Dockerfile and a package file.
_FACTS = """WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 7, '0') AS p FROM customer),
    f AS (SELECT 'dependency' AS kind, 'lib' || k % 40 AS value, 'p' || p || '/requirements.txt' AS path, 1 AS line FROM c UNION ALL SELECT 'dependency', 'pandas', 'p' || p || '/requirements.txt', 2 FROM c
    UNION ALL SELECT 'dependency', 'github.com/a/b' || k % 3, 'p' || p || '/go.mod', 4 FROM c UNION ALL SELECT 'runtime', '1.' || k % 9, 'p' || p || '/go.mod', 2 FROM c UNION ALL SELECT 'runtime', 'python:3.' || k % 14, 'p' || p || '/Dockerfile', 1 FROM c
    UNION ALL SELECT 'config_key', 'PORT_' || k, 'p' || p || '/Dockerfile', 2 FROM c UNION ALL SELECT 'run_command', 'run me', 'p' || p || '/Dockerfile', 3 FROM c UNION ALL SELECT 'dependency', 'left-pad', 'p' || p || '/package.json', 1 FROM c UNION ALL SELECT 'runtime', '>=18', 'p' || p || '/package.json', 1 FROM c),
    g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY path, line) = 1)
    SELECT kind, value, path, line FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY path, line, value) <= 30"""


@query(_FACTS)
def manifest_facts(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    folder = F.concat(F.lit("p"), F.lpad(k, 7, "0"), F.lit("/"))
    n = lambda m: (F.col("c_custkey") % m).cast("string")
    file = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    files = F.array(
        file("requirements.txt", F.concat(F.lit("lib"), n(40), F.lit(">=1\npandas\n# no\npandas\n"))),
        file("go.mod", F.concat(F.lit("module x\ngo 1."), n(9), F.lit("\nrequire (\n\tgithub.com/a/b"), n(3), F.lit(" v1.2.3\n)\n"))),
        file("Dockerfile", F.concat(F.lit("FROM python:3."), n(14), F.lit("\nENV PORT_"), k, F.lit(" 80\nCMD run me\n"))),
        file("package.json", F.lit('{"dependencies": {"left-pad": "^1.0.0"}, "engines": {"node": ">=18"}}')),
    )
    tree = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(folder.alias("folder"), F.explode(files).alias("f"))
    return D.manifest_facts(tree.select(F.concat("folder", "f.name").alias("path"), "f.content"))


@query(f"WITH e AS ({EDGES_SQL}), h AS (SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20) SELECT id, coalesce((SELECT string_agg(DISTINCT src::VARCHAR, ',' ORDER BY src::VARCHAR) FROM e WHERE dst = id), '') AS callers, coalesce((SELECT string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst::VARCHAR) FROM e WHERE src = id), '') AS callees FROM h")
def graph_pivot(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select(F.row_number().over(W.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("pos"), F.col("p_partkey").alias("id")).where("pos <= 90")
    out = D.pivot(hits.union(hits), calls(spark, sf_dir), parts_as_nodes(spark, sf_dir))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), F.lit(""))
    return out.select("id", joined("callers").alias("callers"), joined("callees").alias("callees"))


@query("SELECT event_id AS pos, user_id AS id, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1) AS known FROM events")
def id_existence(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("id"))
    return D.existing(ids, table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id")))


@query("""WITH l AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT path, line, text FROM l WHERE regexp_matches(text, '[Ll]icensed? under') ORDER BY path, line LIMIT 40""")
def grep_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    return D.grep(docs, "[Ll]icensed? under", 40)


@query("SELECT lang, count(*) AS total, count(e.vec_id) AS embedded, count(*) = count(e.vec_id) AS ready FROM documents LEFT JOIN embeddings e ON vec_id = doc_id GROUP BY lang")
def embed_status(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return D.embed_status(table(spark, sf_dir, "documents").select("doc_id", "lang").join(vectors, "doc_id", "left"), "lang", "embedding")


@query("SELECT (sum(length(text)) // 4)::BIGINT AS tokens FROM conversations")
def token_estimate(spark, sf_dir):
    return D.token_estimate(table(spark, sf_dir, "conversations"), "text")


@query("SELECT user_id, event_type AS group_id, CASE WHEN bool_or(event_id % 4 = 0) THEN 'oidc' ELSE 'manual' END AS source FROM events GROUP BY 1, 2")
def membership_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("group_id"), F.when(F.col("event_id") % 4 == 0, "oidc").otherwise("manual").alias("source"))
    return D.memberships(rows)


#: A range is whole if the characters before its start and before its end have so many bytes in all.
@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents), c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS k FROM t WHERE length(text) > 0),
    p AS (SELECT doc_id, k, ch, sum(octet_length(encode(ch))) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM c WHERE k <= 60), w AS (SELECT doc_id, string_agg(ch, '' ORDER BY k) FILTER (upto > 11 AND upto <= 41) AS body, bool_or(upto = 11) AS starts, bool_or(upto = 41) AS ends FROM p GROUP BY doc_id)
    SELECT t.doc_id, CASE WHEN n <= 11 THEN '' WHEN starts AND (ends OR n <= 41) THEN coalesce(body, '') END AS body FROM t LEFT JOIN w USING (doc_id)""")
def byte_ranges(spark, sf_dir):
    """Bytes 11 to 41 of every text; null where they cut a character."""
    return table(spark, sf_dir, "documents").select("doc_id", D.byte_range(F.coalesce("text", F.lit("")).cast("binary"), F.lit(11), F.lit(41)).alias("body"))


@query()
def hdbscan_clusters(spark, sf_dir):
    """Two tenants; importance is a part's price where there is one."""
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_retailprice").alias("importance"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("tenant", F.col("vec_id") % 2).join(price, "vec_id", "left")
    return clusters.clustered(vectors.withColumn("importance", F.coalesce("importance", F.lit(0.0))), "tenant", "vec_id", "embedding", "importance")


@query("SELECT vec_id % 3 AS tenant, min(vec_id) AS first, count(*) AS size FROM embeddings GROUP BY vec_id % 3, label")
def planted_clusters(spark, sf_dir):
    """The first member and the size of each density cluster where the vectors of a label point the same way, whatever their length."""
    k = F.col("vec_id")
    way = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0 + k % 5).otherwise(0.0))
    vectors = table(spark, sf_dir, "embeddings").select((k % 3).alias("tenant"), "vec_id", way.alias("v"))
    labels = clusters.clustered(vectors, "tenant", "vec_id", "v", whole=True)
    return labels.groupBy("tenant", "cluster").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")).drop("cluster")
