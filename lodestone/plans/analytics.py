"""Telemetry, incremental, page, access and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import access as A
from lodestone.operators import hybrid as H
from lodestone.operators import incremental as I
from lodestone.operators import pages as P
from lodestone.operators import telemetry as M
from lodestone.plans.tables import LOGS_SQL, instants, logs, table
from lodestone.sources import files as S
from lodestone.sources.shared import new_path
from lodestone.streaming import changes as C
from lodestone.streaming import usage as U

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH logs AS ({LOGS_SQL}) {sql}" if " logs" in sql and not sql.startswith("WITH") else sql
        return f

    return add


@query("SELECT count(*) AS queries, count_if(result_count = 0)::BIGINT AS empty, count_if(status = 'error')::BIGINT AS errors, sum(tokens)::BIGINT AS tokens, sum(cost_micros)::BIGINT AS cost_micros, count(cost_micros) AS rows_with_cost FROM logs")
def usage_stats(spark, sf_dir):
    return M.window_stats(logs(spark, sf_dir))


@query("SELECT tool, count(*) AS n FROM logs WHERE status <> 'ok' AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY tool")
def usage_filtered(spark, sf_dir):
    out = M.log_filters(logs(spark, sf_dir), since="2024-01-05", until="2024-01-20").where("status != 'ok'")
    return out.groupBy("tool").agg(F.count("*").alias("n"))


_PCT = "s[(round_even({0} * (len(s) - 1), 0))::BIGINT + 1]"


@query(f"SELECT tool, {_PCT.format(0.5)} AS p50, {_PCT.format(0.95)} AS p95 FROM (SELECT tool, list(duration_ms ORDER BY duration_ms) AS s FROM logs GROUP BY tool)")
def usage_percentiles(spark, sf_dir):
    return M.nearest_rank_by(logs(spark, sf_dir), ["tool"], "duration_ms", (50, 95))


@query("SELECT tokens AS value, count(*) AS n FROM logs GROUP BY tokens ORDER BY n DESC, value LIMIT 10")
def top_queries(spark, sf_dir):
    return M.top_values(logs(spark, sf_dir), "tokens", 10).withColumnRenamed("tokens", "value")


@query("""WITH logs AS (""" + LOGS_SQL + """), u AS (SELECT user_id, count(*) AS queries, count_if(source = 'mcp')::BIGINT AS mcp, count_if(source = 'rest')::BIGINT AS rest, count_if(status = 'error')::BIGINT AS errors, sum(tokens)::BIGINT AS tokens FROM logs GROUP BY user_id),
    c AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 2 = 0)
    SELECT user_id, coalesce(queries, 0) AS queries, coalesce(mcp, 0) AS mcp, coalesce(rest, 0) AS rest, coalesce(errors, 0) AS errors, coalesce(tokens, 0) AS tokens, c.user_id IS NOT NULL AS known FROM c FULL JOIN u USING (user_id)""")
def usage_by_user_incl_silent(spark, sf_dir):
    usage = logs(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("queries"), F.count_if(F.col("source") == "mcp").alias("mcp"), F.count_if(F.col("source") == "rest").alias("rest"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("tokens").alias("tokens"))
    users = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return M.per_user(users, usage, "user_id")


def _bucket_sql(unit: str, since: str, until: str) -> str:
    return f"""WITH logs AS ({LOGS_SQL}), c AS (SELECT unnest(range(TIMESTAMP '{since}', TIMESTAMP '{until}', INTERVAL 1 {unit})) AS bucket), b AS (SELECT date_trunc('{unit}', created_at) AS bucket, count(*) AS n, count_if(source = 'mcp')::BIGINT AS mcp, count_if(source <> 'mcp')::BIGINT AS rest
        FROM logs WHERE created_at BETWEEN TIMESTAMP '{since}' AND TIMESTAMP '{until}' GROUP BY 1) SELECT strftime(bucket, '%Y-%m-%d %H') AS bucket, coalesce(n, 0) AS n, coalesce(mcp, 0) AS mcp, coalesce(rest, 0) AS rest FROM c LEFT JOIN b USING (bucket)"""


def _counts():
    return [F.count("*").alias("n"), F.count_if(F.col("source") == "mcp").alias("mcp"), F.count_if(F.col("source") != "mcp").alias("rest")]


@query(_bucket_sql("hour", "2024-01-03 00:00:00", "2024-01-06 00:00:00"))
def usage_timeseries_hour(spark, sf_dir):
    out = M.buckets(logs(spark, sf_dir), "created_at", "hour", "2024-01-03 00:00:00", "2024-01-06 00:00:00", _counts())
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


@query(_bucket_sql("day", "2023-12-20 00:00:00", "2024-02-05 00:00:00"))
def usage_timeseries_day_zero_filled(spark, sf_dir):
    out = M.buckets(logs(spark, sf_dir), "created_at", "day", "2023-12-20 00:00:00", "2024-02-05 00:00:00", _counts())
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH"))


_MODEL = "CASE id % 4 WHEN 0 THEN 'GPT-4o' WHEN 1 THEN 'o1' WHEN 2 THEN 'text-embedding-3-small' ELSE 'unheard-of' END"
_COSTED = f"""SELECT id, tool, {_MODEL} AS model, tokens + 5 AS t, CASE WHEN id % 4 = 3 THEN NULL ELSE ceil(round(CASE id % 4 WHEN 0 THEN (tokens + 5 - least(tokens, tokens + 5)) * 2.5 + least(tokens, tokens + 5) * 1.25 + result_count * 10.0
    WHEN 1 THEN (tokens + 5 - least(tokens, tokens + 5)) * 15.0 + least(tokens, tokens + 5) * 7.5 + result_count * 60.0 ELSE (tokens + 5) * 0.02 END, 9))::BIGINT END AS cost_micros FROM logs"""


def _costed(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ("GPT-4o", "o1", "text-embedding-3-small", "unheard-of"))), (F.col("id") % 4 + 1).cast("int"))
    usage = logs(spark, sf_dir).select("id", "tool", model.alias("model"), (F.col("tokens") + 5).alias("tokens_in"), F.col("result_count").alias("tokens_out"), F.col("tokens").alias("tokens_cached"))
    return M.cost(usage)


@query(f"SELECT id, model, coalesce(cost_micros, -1) AS cost_micros FROM (WITH logs AS ({LOGS_SQL}) {_COSTED})")
def cost_micros(spark, sf_dir):
    return _costed(spark, sf_dir).select("id", "model", F.coalesce("cost_micros", F.lit(-1)).alias("cost_micros"))


@query(f"WITH logs AS ({LOGS_SQL}), c AS ({_COSTED}), p AS (SELECT tool, model, sum(t)::BIGINT AS t, sum(cost_micros)::BIGINT AS c FROM c GROUP BY tool, model) SELECT tool, sum(t)::BIGINT AS tokens, sum(c)::BIGINT AS cost_micros, (SELECT model FROM p q WHERE q.tool = p.tool ORDER BY t DESC, model LIMIT 1) AS dominant_model FROM p GROUP BY tool")
def cost_rollup_dominant_model(spark, sf_dir):
    return M.cost_rollup(_costed(spark, sf_dir), "tool", "model", "tokens_in")


@query("SELECT o_orderpriority AS batch, count_if(o_orderstatus = 'O')::BIGINT AS n_O, count_if(o_orderstatus = 'F')::BIGINT AS n_F, count_if(o_orderstatus = 'P')::BIGINT AS n_P, count(*) AS n, bool_and(o_orderstatus IN ('F', 'O')) AS complete FROM orders GROUP BY 1")
def batch_status_counts(spark, sf_dir):
    return M.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "batch"), "batch", "o_orderstatus", ("O", "F", "P"), ("F", "O"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(range(DATE '1995-01-01', DATE '1995-04-01', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1) USING (d)")
def runs_by_day(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("1995-03-31").cast("date"))).alias("d"))
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return days.join(per, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT l_linestatus AS step, round(avg(days), 6) AS mean_days, median(days) AS median_days, round(avg((l_returnflag <> 'R')::INT), 6) AS success FROM (SELECT *, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def step_durations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("days", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))
    return rows.groupBy(F.col("l_linestatus").alias("step")).agg(F.round(F.avg("days"), 6).alias("mean_days"), F.median("days").alias("median_days"), F.round(F.avg((F.col("l_returnflag") != "R").cast("int")), 6).alias("success"))


@query("SELECT user_id, coalesce(sum(CASE WHEN tool = 'purchase' THEN cost_micros END)::BIGINT, -1) AS cost FROM logs GROUP BY user_id")
def nullable_sum(spark, sf_dir):
    """All-null sums stay null; shown as -1."""
    out = logs(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(F.col("tool") == "purchase", F.col("cost_micros"))).alias("cost"))
    return out.withColumn("cost", F.coalesce("cost", F.lit(-1)))


@query("""SELECT id, 'both' AS w FROM logs WHERE coalesce(CASE WHEN cost_micros > 30 THEN created_at + INTERVAL 1 DAY END, created_at) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'
    UNION ALL SELECT id, 'as_of' FROM logs WHERE coalesce(CASE WHEN cost_micros > 30 THEN created_at + INTERVAL 1 DAY END, created_at) <= TIMESTAMP '2024-01-05' UNION ALL SELECT id, 'open' FROM logs""")
def temporal_window_asof(spark, sf_dir):
    """Rows last changed in a window, as of a time, and without either; some rows were never changed."""
    from datetime import datetime

    rows = logs(spark, sf_dir).withColumn("changed_at", F.when(F.col("cost_micros") > 30, F.col("created_at") + F.make_interval(days=F.lit(1))))
    some = {"both": {"since": datetime(2024, 1, 10), "until": datetime(2024, 1, 20), "as_of": datetime(2024, 1, 25)}, "as_of": {"as_of": datetime(2024, 1, 5)}, "open": {}}
    out = None
    for name, window in some.items():
        part = H.in_window(rows, "changed_at", "created_at", **window).select("id", F.lit(name).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT source, doc_id, substring(trim(regexp_replace(text, '[*_`]+', '', 'g')), 1, 280) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_chunk_excerpt(spark, sf_dir):
    return P.first_per_group(table(spark, sf_dir, "documents"), "source", "doc_id").select("source", "doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, w, n, unnest(range(0, CASE WHEN n <= 512 THEN 1 ELSE ceil((n - 512) / 448.0)::BIGINT + 1 END)) AS chunk_index FROM n)
    SELECT c.doc_id, chunk_index, least(512, n - chunk_index * 448) AS n_words, sha256(CASE WHEN n <= 512 THEN trim(text) ELSE array_to_string(w[chunk_index * 448 + 1:chunk_index * 448 + 512], ' ') END) AS hash FROM c JOIN documents d ON d.doc_id = c.doc_id""")
def word_window_chunks(spark, sf_dir):
    out = P.word_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "n_words", F.sha2("content", 256).alias("hash"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), 1) - 1 AS pos FROM pages)
    SELECT page_id, pos::BIGINT AS pos, substring(raw, 3, 1)::BIGINT AS level, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS heading FROM h""")
def page_headings(spark, sf_dir):
    return P.html_headings(table(spark, sf_dir, "pages")).drop("anchor")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), 1) - 1 AS pos FROM pages)
    SELECT page_id, pos::BIGINT AS pos, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(raw, '<[^>]*>', '', 'g'))), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s-]', '', 'g'), '\s+', '-', 'g'), '-') AS anchor FROM h""")
def page_heading_anchors(spark, sf_dir):
    return P.html_headings(table(spark, sf_dir, "pages")).select("page_id", "pos", "anchor")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, CASE WHEN regexp_matches(href, '^(https?://|mailto:|ftp://)') THEN 'absolute' WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(href, '\\.mdx?$') THEN 'markdown' ELSE 'relative' END AS kind FROM l""")
def page_links_classified(spark, sf_dir):
    return P.html_links(table(spark, sf_dir, "pages")).drop("pos")


@query("""WITH d AS (SELECT page_id AS id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS k FROM pages), n AS (SELECT id, k AS name FROM d UNION SELECT id, regexp_extract(k, '[^/]*$') FROM d), m AS (SELECT name, max(id) AS target FROM n GROUP BY name),
    l AS (SELECT DISTINCT page_id % 7 AS slot, '../' || regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS href FROM pages WHERE page_id % 2 = 0 UNION SELECT DISTINCT page_id % 7, 'no/such/' || page_id FROM pages WHERE page_id % 50 = 1),
    t AS (SELECT slot, href, 1 AS way, href AS name FROM l UNION ALL SELECT slot, href, 2, regexp_replace(href, '^[./]+', '') FROM l UNION ALL SELECT slot, href, 4, regexp_extract(href, '[^/]*$') FROM l)
    SELECT slot, href, coalesce(arg_min(target, way) FILTER (target IS NOT NULL), -1) AS target FROM t LEFT JOIN m USING (name) GROUP BY slot, href""")
def link_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    docs = pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("source_key"))
    good = docs.where("id % 2 = 0").select((F.col("id") % 7).alias("slot"), F.concat(F.lit("../"), "source_key").alias("href"))
    bad = docs.where("id % 50 = 1").select((F.col("id") % 7).alias("slot"), F.concat(F.lit("no/such/"), F.col("id").cast("string")).alias("href"))
    return P.resolve_links(good.union(bad).distinct(), docs).select("slot", "href", F.coalesce("target", F.lit(-1)).alias("target"))


@query("SELECT source, doc_id, sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents QUALIFY used <= 20000")
def section_outline_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return P.budgeted(rows, "source", "doc_id", "text", 20000).select("source", "doc_id", "used")


#: A document on a part's orders mentions the part by name and its qualified name; nodes are all parts.
_MENTIONS = """WITH n AS (SELECT p_partkey AS node_id, replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '')) AS package, p_size AS start_line FROM part),
    c AS (SELECT o_orderkey AS chunk_id, n.name AS raw, n.package FROM orders JOIN n ON n.node_id = o_custkey),
    m AS (SELECT chunk_id, raw, raw AS key, NULL AS qual, package AS own FROM c UNION SELECT chunk_id, package || '.' || raw, raw, package, package FROM c),
    s AS (SELECT chunk_id, raw, node_id, start_line, (CASE WHEN n.package || '.' || n.name = raw THEN 120 WHEN ends_with(n.package || '.' || n.name, raw) THEN 90 ELSE 0 END) + 50 + (CASE WHEN qual = n.package THEN 40 ELSE 0 END) + (CASE WHEN qual IS NOT NULL AND contains(n.package || '.' || n.name, qual) THEN 30 ELSE 0 END)
        + (CASE WHEN qual = n.package THEN 20 ELSE 0 END) + (CASE WHEN own = n.package THEN 15 + 5 * (1 + (node_id % 2)) ELSE 0 END) AS score FROM m JOIN n ON n.name = m.key)
    SELECT chunk_id, raw, node_id, score FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id, raw ORDER BY score DESC, start_line, node_id) = 1"""


@query(_MENTIONS)
def mention_linking_best(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    package = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    nodes = part.select(F.col("p_partkey").alias("node_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), package.alias("package"), F.col("p_size").cast("long").alias("start_line"))
    nodes = nodes.select("*", F.concat_ws(".", "package", "name").alias("qualified_name"), F.concat("package", F.when(F.col("node_id") % 2 == 1, "/guide/x.py").otherwise("/x.py")).alias("file_path"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("node_id")).join(nodes, "node_id")
    chunks = orders.select("chunk_id", F.concat("package", F.lit("/guide/notes.md")).alias("doc_path"), F.concat(F.lit("See `"), "name", F.lit("` and "), "qualified_name", F.lit(" there")).alias("content"))
    return P.link_mentions(chunks, nodes)


@query("SELECT 'src/' || lang AS path, sum(n_chars)::BIGINT AS bytes FROM documents WHERE n_chars BETWEEN 1 AND 1048576 GROUP BY 1")
def language_bytes(spark, sf_dir):
    ext = F.create_map(*[F.lit(x) for kv in (("en", ".py"), ("de", ".go"), ("fr", ".ts"), ("es", ".rs")) for x in kv])
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), ext[F.col("lang")]).alias("path"), F.col("n_chars").alias("size"))
    back = F.create_map(*[F.lit(x) for kv in (("python", "en"), ("go", "de"), ("typescript", "fr"), ("rust", "es")) for x in kv])
    return S.language_bytes(files).select(F.concat(F.lit("src/"), back[F.col("language")]).alias("path"), "bytes")


@query("SELECT split_part(regexp_extract(url, '://[^/]*/(.*)', 1), '/', 1) AS directory, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, directory LIMIT 30")
def top_directories(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.split_part(F.regexp_extract("url", "://[^/]*/(.*)", 1), F.lit("/"), F.lit(1)).alias("directory"))
    return M.top_values(rows, "directory", 30)


_SEEN = """WITH rows AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'public' ELSE 'private' END AS visibility, c_acctbal < 0 AS deleted, c_nationkey FROM customer),
    g AS (SELECT c_custkey AS id, c_nationkey AS grp FROM customer), m AS (SELECT n_nationkey AS grp, n_regionkey AS usr FROM nation) SELECT id FROM rows WHERE NOT deleted AND {0}"""


def _scope(spark, sf_dir, **caller):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "public").otherwise("private").alias("visibility"), (F.col("c_acctbal") < 0).alias("deleted"))
    grants = c.select(F.col("c_custkey").alias("resource_id"), F.col("c_nationkey").alias("group_id"))
    members = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_regionkey").alias("user_id"))
    return A.readable(rows, grants, members, **caller).select("id")


@query(_SEEN.format("(visibility = 'public' OR id IN (SELECT g.id FROM g JOIN m USING (grp) WHERE usr = 2))"))
def acl_read_scope_user(spark, sf_dir):
    return _scope(spark, sf_dir, user=2)


@query(_SEEN.format("visibility = 'public'"))
def acl_read_scope_anon(spark, sf_dir):
    return _scope(spark, sf_dir)


@query(_SEEN.format("true"))
def acl_read_scope_admin(spark, sf_dir):
    return _scope(spark, sf_dir, user=2, role="admin")


@query("SELECT c_custkey % 7 AS user_id, n_regionkey AS resource_id, CASE WHEN max(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END) = 2 THEN 'write' ELSE 'read' END AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def best_permission(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grants = rows.select(F.col("c_custkey").alias("group_id"), F.col("n_regionkey").alias("resource_id"), F.when(F.col("c_mktsegment") == "BUILDING", "write").otherwise("read").alias("permission"))
    members = rows.select((F.col("c_custkey") % 7).alias("user_id"), F.col("c_custkey").alias("group_id"))
    return A.best_permission(grants, members)


#: Both versions are shares of all documents by a hash of their id: one in eight is gone, one in eight is new, and every tenth text changed.
_SHARE = "(doc_id * 2654435761 % 4294967296) // 536870912"
_OLD = f"SELECT doc_id, sha256(text) AS h FROM documents WHERE {_SHARE} <> 0"
_NEW = f"SELECT doc_id, sha256(text || CASE WHEN doc_id % 10 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE {_SHARE} <> 7"


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    share = "(doc_id * 2654435761 % 4294967296) div 536870912"
    old = d.where(f"{share} != 0").select("doc_id", F.sha2("text", 256).alias("h"), (F.col("doc_id") + 1_000_000).alias("id"))
    new = d.where(f"{share} != 7").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 10 == 0, "!").otherwise("")), 256).alias("h"), (F.col("doc_id") + 2_000_000).alias("id"))
    return old, new


@query(f"SELECT doc_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (doc_id)")
def incremental_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return I.diff(old, new, ["doc_id"], "h")


@query(f"SELECT doc_id, CASE WHEN o.h IS NULL THEN doc_id + 2000000 ELSE doc_id + 1000000 END AS id, CASE WHEN o.h IS NULL THEN 'insert' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (doc_id)")
def merge_keeps_ids(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return I.merge(old, new, ["doc_id"], "id", "h").select("doc_id", "id", "action")


@query(f"SELECT doc_id FROM ({_OLD}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_NEW}))")
def prune_orphans(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return I.orphans(old, new, ["doc_id"]).select("doc_id")


@query(f"SELECT n.doc_id FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (doc_id) WHERE o.h IS DISTINCT FROM n.h")
def skip_unchanged(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return I.changed(old, new, ["doc_id"], "h").select("doc_id")


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), p AS (SELECT doc_id // 5 AS page, doc_id, h FROM o), s AS (SELECT page, count(*) FILTER (n.h IS NULL) AS missing, count(*) FILTER (n.h <> p.h) AS changed FROM p LEFT JOIN n USING (doc_id) GROUP BY page)
    SELECT page, CASE WHEN page % 17 = 0 THEN 'schema_version' WHEN page % 13 = 0 THEN 'quality_unknown' WHEN page % 11 = 0 THEN 'quality_degraded' WHEN missing > 0 THEN 'cited_node_missing' WHEN changed > 0 THEN 'cited_node_content_changed' ELSE 'clean' END AS reason FROM s""")
def dirty_reasons(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    state = I.citation_state(old.withColumn("page", F.expr("doc_id div 5")), new, "page", "doc_id", "h")
    version = F.when(F.col("page") % 17 == 0, 1).otherwise(2)
    quality = F.when(F.col("page") % 13 == 0, F.lit(None)).when(F.col("page") % 11 == 0, "degraded").otherwise("ok")
    reason = I.dirty_reason(F.lit(True), version, 2, F.lit("s"), F.lit("s"), quality, F.col("missing"), F.lit(0), F.col("changed"), F.lit(None), F.lit("f"))
    return state.select("page", F.coalesce(reason, F.lit("clean")).alias("reason"))


@query(f"""WITH o AS (SELECT *, ['degraded', 'partial', 'ok'][doc_id % 3 + 1] AS q, doc_id % 3 AS r FROM ({_OLD})), n AS (SELECT *, ['degraded', 'partial', 'ok'][doc_id % 2 + 1] AS q, doc_id % 2 AS r FROM ({_NEW}))
    SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN o.h = n.h THEN 'touch' WHEN n.r < o.r THEN 'keep' ELSE 'write' END AS action FROM n LEFT JOIN o USING (doc_id)""")
def quality_upsert(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    named = lambda n: F.element_at(F.array(*map(F.lit, I.QUALITY)), (F.col("doc_id") % n + 1).cast("int"))
    return I.quality_upsert(old.withColumn("q", named(3)), new.withColumn("q", named(2)), "doc_id", "h", "q").select("doc_id", "action")


#: Changes of orders: added (1), renamed (2), renamed again (3), the first name taken again (4), the last deleted (5), renamed back onto the second (6).
_FEED = """SELECT o_orderkey AS k, 1 AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'M' END AS kind, NULL::BIGINT AS old, 'v1' AS v FROM orders WHERE o_orderkey % 10 < 5
    UNION ALL SELECT o_orderkey + 1000000000, 2, 'R', o_orderkey, 'v2' FROM orders WHERE o_orderkey % 10 < 4
    UNION ALL SELECT o_orderkey + 2000000000, 3, 'R', o_orderkey + 1000000000, 'v3' FROM orders WHERE o_orderkey % 10 < 3
    UNION ALL SELECT o_orderkey, 4, 'A', NULL, 'v4' FROM orders WHERE o_orderkey % 10 = 1
    UNION ALL SELECT o_orderkey + 2000000000, 5, 'D', NULL, 'v5' FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT o_orderkey + 1000000000, 6, 'R', o_orderkey + 2000000000, 'v6' FROM orders WHERE o_orderkey % 10 = 0"""
_APPLIED = f"""WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0), c AS ({_FEED}),
    x AS (SELECT k, n, kind <> 'D' AS alive, v FROM c UNION ALL SELECT old, n, false, NULL FROM c WHERE kind = 'R'), l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, alive DESC) = 1)
    SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT k, v FROM l WHERE alive"""


def _feed(spark, sf_dir):
    """The changes, and the table that they change."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    far = lambda n: k + n * 1_000_000_000 if n else k
    none = F.lit(None).cast("long")
    steps = ((k % 10 < 5, 0, F.when(k % 2 == 0, "A").otherwise("M"), none), (k % 10 < 4, 1, F.lit("R"), k), (k % 10 < 3, 2, F.lit("R"), far(1)), (k % 10 == 1, 0, F.lit("A"), none), (k % 10 == 2, 2, F.lit("D"), none), (k % 10 == 0, 1, F.lit("R"), far(2)))
    feed = None
    for n, (some, new, kind, old) in enumerate(steps, 1):
        rows = o.where(some).select(far(new).alias("k"), F.lit(n).alias("n"), kind.alias("kind"), old.alias("old"), F.lit(f"v{n}").alias("v"))
        feed = rows if feed is None else feed.unionByName(rows)
    return feed, o.where(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("v"))


@query(_APPLIED)
def cdc_apply(spark, sf_dir):
    """Rename chains, names taken again and deletions in one feed."""
    feed, base = _feed(spark, sf_dir)
    return I.apply_changes(base, feed, "k", "n", "kind", "old")


@query(_APPLIED)
def cdc_stream(spark, sf_dir):
    """The feed as a stream of several micro-batches in an order that isn't the changes' own, with a batch that is played twice and a compaction between."""
    feed, base = _feed(spark, sf_dir)
    source, path, state = (new_path(spark, f"feed-{n}") for n in ("in", "parts", "state"))
    feed.repartition(5, F.pmod(F.xxhash64("k", "n"), F.lit(5))).write.parquet(source)
    write = C.writer(path, "k", "n", "kind", "old", ["k", "v"])
    stream = U.read_stream(spark, source, maxFilesPerTrigger=1)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    write(spark.read.parquet(source).limit(0), 5)  # nothing more came
    C.compact(spark, path)
    write(feed.where("n = 2"), 1)  # played again after its part was folded
    return C.current(spark, path, base, "k")


@query("SELECT page, streak FROM (SELECT user_id AS page, count(*) FILTER (event_type = 'click' AND ts > coalesce(last, TIMESTAMP '1970-01-01')) AS streak FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY 1)")
def edit_streaks(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "write")
    return I.edit_streak(table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts", kind.alias("kind")), "page", "ts", "kind")


@query("SELECT role, sha256(text) AS key, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1, 2")
def evidence_dedupe_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.sha2("text", 256).alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("first"))
    return P.first_per_group(rows.withColumn("_g", F.concat_ws("\x1f", "role", F.coalesce("key", F.lit("")))), "_g", "first").select("role", "key", "first")


@query("SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def citation_gate_antijoin(spark, sf_dir):
    cited = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return P.ungrounded(cited, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")), ["conv_id"])


#: Lines: # role, ## A, a fence with ## not, ### B, text, ## C, then the text (which has no headings).
@query("""WITH t AS (SELECT conv_id, max('# ' || role || chr(10) || '## A' || chr(10) || '```' || chr(10) || '## not' || chr(10) || '```' || chr(10) || '### B' || chr(10) || 'text' || chr(10) || '## C' || chr(10) || text) AS text FROM conversations GROUP BY conv_id)
    SELECT conv_id, u.* FROM t, (VALUES (1, 2, 'A', 2, 7), (2, 3, 'B', 6, 7), (3, 2, 'C', 8, NULL)) u(section, level, heading, first_line, end_line)""")
def coverage_sections(spark, sf_dir):
    md = F.concat(F.lit("# "), "role", F.lit("\n## A\n```\n## not\n```\n### B\ntext\n## C\n"), "text")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(md).alias("text"))
    return P.sections(rows, "conv_id", "text")


@query("""WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings ), t AS (SELECT vec_id, v, ['l' || label, 'g' || vec_id // 8, 'h' || (vec_id * 7 % 1009) // 4, 'm' || vec_id % 2] AS w FROM p),
    j AS (SELECT a.vec_id AS a, b.vec_id AS b, len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(a.w || b.w)) AS j, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM t a JOIN t b ON a.vec_id < b.vec_id)
    SELECT a, b, round(j::DOUBLE, 6) AS jaccard, round(c, 6) AS cosine FROM j WHERE j >= 0.5 AND c >= -0.2""")
def plan_overlap_pairs(spark, sf_dir):
    named = lambda mark, value: F.concat(F.lit(mark), F.expr(value).cast("string"))
    tokens = F.array(named("l", "label"), named("g", "vec_id div 8"), named("h", "(vec_id * 7 % 1009) div 4"), named("m", "vec_id % 2"))
    rows = table(spark, sf_dir, "embeddings").withColumn("tokens", tokens)
    return P.overlapping_pairs(rows, "vec_id", "tokens", "embedding", 0.5, -0.2).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"))


_SAL = "round(0.3 * (len(html) > 4000)::INT + 0.25 * contains(url, '/en/')::INT + 0.2 * starts_with(url, 'https')::INT - 0.2 * contains(url, 'spam')::INT, 6)"


@query(f"SELECT page_id, {_SAL}::DOUBLE AS score, CASE WHEN {_SAL} >= 0.55 THEN 'public' WHEN {_SAL} >= 0.4 THEN 'supporting' WHEN {_SAL} >= 0.2 THEN 'internal' ELSE 'test_scaffolding' END AS tier FROM pages")
def salience_tiers(spark, sf_dir):
    w = P.SALIENCE
    s = w["readme_heading"] * (F.length("html") > 4000).cast("int") + w["readme_code"] * F.col("url").contains("/en/").cast("int") + w["exported"] * F.col("url").startswith("https").cast("int") + w["internal_path"] * F.col("url").contains("spam").cast("int")
    return table(spark, sf_dir, "pages").select("page_id", F.round(s, 6).alias("score")).withColumn("tier", P.salience(F.col("score")))


@query(f"WITH t AS (SELECT split_part(regexp_extract(url, '://[^/]*/(.*)', 1), '/', 1) AS cluster, {_SAL} AS s FROM pages) SELECT cluster, least(count(*) FILTER (s >= 0.55 OR (s >= 0.4 AND s >= 0.65)), 6) AS pages FROM t GROUP BY cluster")
def tier_quota(spark, sf_dir):
    scored = salience_tiers(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.split_part(F.regexp_extract("url", "://[^/]*/(.*)", 1), F.lit("/"), F.lit(1)).alias("cluster")), "page_id")
    return scored.groupBy("cluster").agg(F.least(F.count_if(P.eligible(F.col("tier"), F.lit("path"), F.col("score"))), F.lit(6)).cast("long").alias("pages"))


@query("SELECT role, median(n)::DOUBLE AS median_chars, round(avg((n > 200)::INT), 6) AS long_share, count(*) AS n FROM (SELECT role, length(text) AS n FROM conversations) GROUP BY role")
def eval_score_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("n"))
    return rows.groupBy("role").agg(F.median("n").alias("median_chars"), F.round(F.avg((F.col("n") > 200).cast("int")), 6).alias("long_share"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS other, user_id, ts AS t FROM events WHERE event_type = 'click')
    SELECT event_id, other FROM a JOIN b USING (user_id) WHERE t BETWEEN ts - INTERVAL 30 MINUTE AND ts + INTERVAL 30 MINUTE QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY t, other) = 1""")
def interval_join_batches(spark, sf_dir):
    """The interval is cut into buckets of its own width, so that the join is on equality."""
    e, width = table(spark, sf_dir, "events"), 1800
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.explode(F.sequence(F.expr(f"unix_seconds(ts) div {width} - 1"), F.expr(f"unix_seconds(ts) div {width} + 1"))).alias("slot"))
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("at"), F.expr(f"unix_seconds(ts) div {width}").alias("slot"))
    near = a.join(b, ["user_id", "slot"]).where("at between ts - interval 30 minutes and ts + interval 30 minutes")
    return P.first_per_group(near, "event_id", "at", "other").select("event_id", "other")


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def page_offset_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return A.paged(d.select("doc_id", "n_chars"), 3, 25, F.desc("n_chars"), "doc_id").join(F.broadcast(A.page_info(d, 25).select("total")))


def _played(spark, stream, name: str):
    """The rows of a stream after it has read all there is; written to files and read back."""
    at = new_path(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bucket, event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('hour', max(ts) - INTERVAL 1 DAY) FROM events) GROUP BY 1, 2")
def stream_usage_window(spark, sf_dir):
    """Windows that the watermark has closed once the whole table is read."""
    events = instants(U.read_stream(spark, f"{sf_dir}/events.parquet"))
    out = _played(spark, U.windowed(events, "ts", "1 hour", ["event_type"], [F.count("*").alias("n")]), "usage-window")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), "event_type", "n")


_RATE = """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, ts, n, ts AS s, 1 AS hit FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.ts, e.n, CASE WHEN e.ts >= r.s + INTERVAL 6 HOUR THEN e.ts ELSE r.s END, CASE WHEN e.ts >= r.s + INTERVAL 6 HOUR THEN 1 ELSE r.hit + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, count(*) AS hits, count_if(hit <= 2)::BIGINT AS allowed, count(DISTINCT s) AS windows FROM r GROUP BY user_id"""


@query(_RATE)
def rate_limit_replay(spark, sf_dir):
    out = U.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", 2, 6 * 3600)
    return out.groupBy("user_id").agg(F.count("*").alias("hits"), F.count_if("allowed").alias("allowed"), F.count_distinct("window_start").alias("windows"))


@query(_RATE.split("SELECT user_id, count(*) AS hits")[0] + "SELECT user_id, s AS ts FROM r GROUP BY user_id, s")
def dedup_ttl(spark, sf_dir):
    """Rows that a key of six hours lets through; keys come back."""
    return U.first_seen(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")


#: What a watermark three days behind the newest row has passed.
_PASSED = "epoch_ms({0}) <= epoch_ms((SELECT max(ts) FROM events)) - 3 * 86400000"


PART_ROWS = 1_000_000


def _disordered(spark, sf_dir):
    """The events as a stream of six parts, a part at a time, each with rows up to two days older than those before it.

    A part is one file for each PART_ROWS rows of the table, begun. Files are written and read by tasks of their own; a row without a time, which
    streams leave out, stands in each, so that none is missing and a micro-batch is always one whole part.
    """
    source = new_path(spark, "events-in")
    shifted = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86400))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("s", shifted)
    low, high, n = events.agg(F.min("s"), F.max("s"), F.count("*")).first()
    files = n // PART_ROWS + 1
    part = F.least(F.lit(5), F.floor((F.col("s") - (low or 0)) * 6 / ((high or 0) - (low or 0) + 1))).cast("int")
    dealt = events.withColumn("file", F.pmod(F.hash("event_id"), F.lit(files)).cast("int"))
    blank = spark.range(files).select(F.col("id").cast("int").alias("file"))
    for k in range(6):  # one after the other, so that the parts are read in this order
        rows = dealt.where(part == k).unionByName(blank, allowMissingColumns=True)
        rows.repartitionById(files, "file").select("event_id", "user_id", "ts").write.mode("append").parquet(source)
    return U.read_stream(spark, source, maxFilesPerTrigger=files)


@query(_RATE.split("SELECT user_id, count(*) AS hits")[0] + f"SELECT user_id, s AS ts FROM r WHERE {_PASSED.format('s')} GROUP BY user_id, s")
def stream_dedup_ttl(spark, sf_dir):
    """The rows that a key of six hours lets through, from a stream in disorder: those that its watermark has passed."""
    return _played(spark, U.first_seen(_disordered(spark, sf_dir), "ts", ["user_id"], "6 hours", "3 days"), "dedup")


@query(_RATE.split("SELECT user_id, count(*) AS hits")[0] + f"SELECT user_id, ts AS at, s AS window_start, hit::BIGINT AS hit, hit <= 2 AS allowed FROM r WHERE {_PASSED.format('ts')}")
def rate_limit_stream(spark, sf_dir):
    """Every hit of a stream in disorder, counted in the order of time."""
    return _played(spark, U.rate_limited_stream(_disordered(spark, sf_dir), "user_id", "ts", 2, 6 * 3600, "3 days"), "rates")


@query("SELECT id FROM (SELECT o_orderkey AS id, o_orderdate AS t, o_orderstatus AS s FROM orders) WHERE s = 'O' AND t < TIMESTAMP '1998-01-01' - INTERVAL 15 MINUTE AND id % 3 <> 0")
def stale_run_sweep(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.lit(None).cast("timestamp").alias("started_at"), F.col("o_orderdate").alias("created_at"))
    return U.stale_runs(runs, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")), F.lit("1998-01-01").cast("timestamp")).select("id")


@query("""SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 1 THEN CASE WHEN date_trunc('day', ts) + INTERVAL 6 HOUR <= ts THEN date_trunc('day', ts) + INTERVAL 30 HOUR ELSE date_trunc('day', ts) + INTERVAL 6 HOUR END
    ELSE CASE WHEN isodow(ts) = 1 AND date_trunc('day', ts) + INTERVAL 6 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 6 HOUR ELSE date_trunc('week', ts) + INTERVAL 174 HOUR END END, '%Y-%m-%d %H:%M') AS due FROM events""")
def next_sync_times(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("hourly", "daily", "weekly"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(U.next_sync(kind, F.col("ts"), 6), "yyyy-MM-dd HH:mm").alias("due"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def retention(spark, sf_dir):
    return U.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31").cast("timestamp"), 10).select("event_id")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts >= before + INTERVAL 2 HOUR GROUP BY user_id")
def session_counts(spark, sf_dir):
    return U.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"))
