"""Graph queries over parts as nodes and order neighbourhoods as calls."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.operators import extract
from lodestone.operators import graph as G
from lodestone.plans.tables import EDGES_SQL, NODES_SQL, calls, parts_as_nodes, table
from lodestone.sources.shared import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL}), {sql}" if sql.startswith("x AS") else sql
        return f

    return add


@query("x AS (SELECT 1) SELECT id, name, file_path, start_line FROM nodes WHERE node_type IN ('module', 'class', 'struct', 'interface') ORDER BY file_path, start_line, name, id LIMIT 100")
def graph_list_architecture(spark, sf_dir):
    return G.listed(parts_as_nodes(spark, sf_dir), 100, view="architecture").select("id", "name", "file_path", "start_line")


@query("x AS (SELECT 1) SELECT language, count(*) AS n, count_if(node_type = 'class')::BIGINT AS classes, count_if(contains(lower(name), 'red'))::BIGINT AS named FROM nodes GROUP BY language")
def graph_stats(spark, sf_dir):
    n = parts_as_nodes(spark, sf_dir)
    return n.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("node_type") == "class").alias("classes"), F.count_if(F.lower("name").contains("red")).alias("named"))


@query("x AS (SELECT id FROM nodes WHERE language = 'python' AND starts_with(file_path, 'Brand#1') ORDER BY file_path, start_line, name, id LIMIT 400) SELECT src, dst, type FROM edges WHERE src IN (FROM x) AND dst IN (FROM x)")
def graph_edges_selected(spark, sf_dir):
    chosen = G.listed(parts_as_nodes(spark, sf_dir), 400, language="python", module="Brand#1")
    return G.edges_among(calls(spark, sf_dir), chosen)


@query("x AS (SELECT 'caller' AS direction, src AS id FROM edges WHERE dst = 7 UNION SELECT 'callee', dst FROM edges WHERE src = 7) SELECT direction, id, name FROM x JOIN nodes USING (id)")
def node_detail_callers_callees(spark, sf_dir):
    return G.neighbours(calls(spark, sf_dir), parts_as_nodes(spark, sf_dir), 7)


@query("""SELECT n.n_name AS name, r.r_name AS parent, count(s.s_suppkey) AS members FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2""")
def node_members_and_parent(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    members = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    out = n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(members, "n_nationkey", "left")
    return out.select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.coalesce("members", F.lit(0)).alias("members"))


@query("x AS (SELECT 7::BIGINT AS id, 0::BIGINT AS distance UNION SELECT e.dst, x.distance + 1 FROM x JOIN edges e ON e.src = x.id WHERE x.distance < 2) SELECT id, min(distance) AS distance FROM x GROUP BY id")
def bfs_callees(spark, sf_dir):
    return G.bfs(stored(calls(spark, sf_dir), "calls"), spark.createDataFrame([(7,)], "id long"), 2)


@query("x AS (SELECT 9::BIGINT AS id, 0::BIGINT AS distance UNION SELECT e.b, x.distance + 1 FROM x JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) e ON e.a = x.id WHERE x.distance < 2) SELECT id, min(distance) AS distance FROM x GROUP BY id")
def bfs_both(spark, sf_dir):
    return G.bfs(stored(calls(spark, sf_dir), "calls"), spark.createDataFrame([(9,)], "id long"), 2, "both")


#: Hops from the root; of each hop's finds, in the order of the position they are found from, callers before callees, then id, until 40 are.
_CAPPED = """x AS (SELECT 1), st AS (SELECT dst AS at, src AS id, 0 AS way FROM edges UNION SELECT src, dst, 1 FROM edges), h0 AS (SELECT 9::BIGINT AS id, 0::BIGINT AS distance, 0::BIGINT AS position), v0 AS (SELECT id, distance FROM h0), """ + ", ".join(
    f"f{k} AS (SELECT st.id, min(ROW(h.position, st.way)) AS o FROM h{k - 1} h JOIN st ON st.at = h.id WHERE st.id NOT IN (SELECT id FROM v{k - 1}) GROUP BY st.id), "
    f"h{k} AS (SELECT id, {k}::BIGINT AS distance, row_number() OVER (ORDER BY o, id) AS position FROM f{k} QUALIFY position <= 41 - (SELECT count(*) FROM v{k - 1})), v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT id, distance FROM h{k})"
    for k in (1, 2, 3)
) + " SELECT id, distance FROM v3"


@query(_CAPPED)
def bfs_both_capped(spark, sf_dir):
    return G.bfs(stored(calls(spark, sf_dir), "calls"), spark.createDataFrame([(9,)], "id long"), 3, "both", max_nodes=40)


def _ranks(rounds: int) -> str:
    """PageRank unrolled, in SQL."""
    steps = ["n AS (SELECT count(*)::DOUBLE AS n FROM nodes), g AS (SELECT src, count(*) AS d FROM edges GROUP BY src), r0 AS (SELECT id, 1.0 / n AS r FROM nodes, n)"]
    for k in range(rounds):
        steps.append(
            f"""l{k} AS (SELECT coalesce(sum(r), 0) AS l FROM r{k} WHERE id NOT IN (SELECT src FROM g)),
            m{k} AS (SELECT dst AS id, sum(r / d) AS s FROM edges JOIN g USING (src) JOIN r{k} ON r{k}.id = src GROUP BY dst),
            r{k + 1} AS (SELECT id, 0.15 / n + 0.85 * (coalesce(s, 0) + l / n) AS r FROM nodes LEFT JOIN m{k} USING (id), l{k}, n)"""
        )
    return ", ".join(steps)


@query()
def pagerank_converged(spark, sf_dir):
    """The production rule: until ranks move less than 1e-6 in all, 50 rounds at most. Tested by plain iteration."""
    return G.pagerank(calls(spark, sf_dir), parts_as_nodes(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@query(f"x AS (SELECT 1), {_ranks(10)} SELECT id, round(r / (SELECT sum(r) FROM r10), 9) AS rank FROM r10")
def pagerank(spark, sf_dir):
    """Ten rounds, so that SQL can follow."""
    out = G.pagerank(calls(spark, sf_dir), parts_as_nodes(spark, sf_dir), rounds=10, tolerance=0.0)
    return out.select("id", F.round("rank", 9).alias("rank"))


@query("""x AS (SELECT DISTINCT src, 'inherits' AS type, regexp_extract(n.qualified_name, '[^.]*$') AS target FROM edges JOIN nodes n ON n.id = dst WHERE src % 3 = 0
    UNION SELECT DISTINCT src, 'calls', n.qualified_name FROM edges JOIN nodes n ON n.id = dst WHERE src % 3 = 1 UNION SELECT DISTINCT src, 'calls', n.name FROM edges JOIN nodes n ON n.id = dst WHERE src % 3 = 2),
    e AS (SELECT qualified_name AS target, min(id) AS exact FROM nodes GROUP BY 1),
    s AS (SELECT id, name AS target FROM nodes UNION SELECT id, regexp_extract(qualified_name, '[^.]*$') FROM nodes),
    o AS (SELECT target, min(id) AS sole FROM s GROUP BY target HAVING count(*) = 1)
    SELECT src, type, target, coalesce(coalesce(exact, CASE WHEN type = 'inherits' THEN sole END), -1) AS dst FROM x LEFT JOIN e USING (target) LEFT JOIN o USING (target)""")
def edge_resolution(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir)
    named = calls(spark, sf_dir).select("src", F.col("dst").alias("id")).join(nodes.select("id", "name", "qualified_name"), "id")
    kind = F.when(F.col("src") % 3 == 0, "inherits").otherwise("calls")
    target = F.when(F.col("src") % 3 == 0, F.regexp_extract("qualified_name", "[^.]*$", 0)).when(F.col("src") % 3 == 1, F.col("qualified_name")).otherwise(F.col("name"))
    out = G.resolve(named.select("src", kind.alias("type"), target.alias("target")), nodes)
    return out.withColumn("dst", F.coalesce("dst", F.lit(-1)))


@query("x AS (SELECT 1) SELECT id, qualified_name, array_to_string(overloads, ',') AS overloads FROM (SELECT *, list(id) OVER (PARTITION BY qualified_name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS overloads, row_number() OVER (PARTITION BY qualified_name ORDER BY id DESC) AS n FROM nodes) WHERE n = 1")
def overload_dedupe(spark, sf_dir):
    nodes = parts_as_nodes(spark, sf_dir).select("id", "qualified_name", F.col("id").cast("string").alias("signature"))
    return G.dedupe_overloads(nodes, "qualified_name", "id", "signature").select("id", "qualified_name", F.array_join("overloads", ",").alias("overloads"))


for _name in ("overload_dedupe",):
    SQL[_name] = SQL[_name].replace("array_to_string(overloads, ',')", "coalesce(array_to_string(overloads, ','), '')")


@query("x AS (SELECT id FROM nodes) SELECT * FROM (SELECT id, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM edges WHERE dst = id), '') AS callers, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE src = id), '') AS callees FROM x) WHERE callers <> '' OR callees <> ''")
def adjacency_arrays(spark, sf_dir):
    out = G.adjacency(calls(spark, sf_dir))
    return out.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query("x AS (SELECT id FROM nodes WHERE id % 20 = 0), m AS (SELECT DISTINCT root, id, 1 AS far FROM (SELECT src AS root, dst AS id FROM edges UNION ALL SELECT dst, src FROM edges) WHERE root IN (FROM x) UNION ALL SELECT id, id, 0 FROM x), i AS (SELECT p_partkey AS id, p_retailprice AS importance FROM part) SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY far, CASE WHEN far = 0 THEN 0 ELSE importance END DESC, id) AS place FROM m JOIN i USING (id) QUALIFY place <= 20")
def subgraph_members_topk(spark, sf_dir):
    importance = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("importance"))
    return G.subgraph_members(calls(spark, sf_dir), parts_as_nodes(spark, sf_dir).where("id % 20 = 0").select("id"), importance)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT label, unnest(e) AS x, unnest(range(1, 65)) AS k FROM v),
    c AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS m FROM u GROUP BY label, k) GROUP BY label),
    s AS (SELECT label, vec_id, round(list_dot_product(e, c) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c, c))), 9) AS near FROM v JOIN c USING (label))
    SELECT label, count(*) AS size, (SELECT vec_id FROM s t WHERE t.label = s.label ORDER BY near DESC, vec_id LIMIT 1) AS member FROM s GROUP BY label""")
def cluster_centroid_member(spark, sf_dir):
    return G.cluster_members(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("x AS (SELECT id, id % 10 AS cluster FROM nodes), b AS (SELECT e.src, e.dst, s.cluster AS cs, d.cluster AS cd FROM edges e JOIN x s ON s.id = e.src JOIN x d ON d.id = e.dst) SELECT cluster, (SELECT count(DISTINCT src) FROM b WHERE cd = cluster AND cs <> cluster) AS fan_in, (SELECT round(avg((cd = cluster)::INT), 9) FROM b WHERE cs = cluster) AS containment FROM (SELECT DISTINCT cluster FROM x)")
def cluster_fanin_containment(spark, sf_dir):
    members = parts_as_nodes(spark, sf_dir).select("id", (F.col("id") % 10).alias("cluster"))
    return G.cluster_links(calls(spark, sf_dir), members).withColumn("containment", F.round("containment", 9))


@query("""WITH l AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey AS sha, l_shipdate AS t FROM lineitem),
    h AS (SELECT path, sha, t, (i - 1) * 40 + 1 AS a, (i - 1) * 40 + 5 + i * 5 AS b FROM l), n AS (SELECT o_orderkey AS path, o_orderkey % 97 + 1 AS a, o_orderkey % 97 + 1 + o_orderkey % 150 AS b FROM orders)
    SELECT path, arg_min(sha, ROW(t, sha)) AS first_sha, arg_max(sha, ROW(t, sha)) AS last_sha, strftime(max(t), '%Y-%m-%d') AS last_day FROM n JOIN h USING (path) WHERE h.a <= n.b AND n.a <= h.b GROUP BY path""")
def range_join_blame(spark, sf_dir):
    """Nodes of up to 150 lines against hunks of 10 to 40 lines with gaps between them."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("i", place)
    hunks = rows.select(F.col("l_orderkey").alias("path"), ((F.col("i") - 1) * 40 + 1).alias("first"), (5 + F.col("i") * 5).alias("count"), F.col("l_partkey").alias("sha"), F.col("l_shipdate").alias("committed_at"))
    start = F.col("o_orderkey") % 97 + 1
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("path"), start.alias("start_line"), (start + F.col("o_orderkey") % 150).alias("end_line"))
    return extract.attribution(nodes, hunks).select(F.col("id").alias("path"), "first_sha", "last_sha", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))
