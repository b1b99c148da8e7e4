"""Retrieval and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import gram_index as GI
from lodestone.operators import hybrid as H
from lodestone.operators import pages as P
from lodestone.operators import retrieval as R
from lodestone.operators import routing
from lodestone.operators import token_index as TI
from lodestone.operators import vector_index as VI
from lodestone.plans.tables import table
from lodestone.sources.shared import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Cosine of every vector with that of vec_id 0.
_NEAR = """SELECT e.vec_id, e.label, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS s
    FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) e,
         (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0) q"""
#: Words of one stem.
_LICENSES = ("licens", "license", "licenses", "licensed", "licensing", "licenser", "licensers", "licensable")
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, len(w)::BIGINT + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _words(spark, sf_dir, english: bool = False) -> TI.TokenIndex:
    """The index of all documents' words, built by the first query that needs it."""
    return TI.token_index(table(spark, sf_dir, "documents"), "doc_id", english=english)


def _probe(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_NEAR}) ORDER BY s DESC, vec_id LIMIT 10")
def vector_knn(spark, sf_dir):
    hits = R.vector_stream(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 10)
    return hits.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_NEAR}) WHERE label IN (1, 3) ORDER BY s DESC, vec_id LIMIT 10")
def vector_knn_filtered(spark, sf_dir):
    scope = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3))
    return R.vector_stream(scope, _probe(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(n * 0.1, 6) AS score FROM (SELECT doc_id, len(list_filter({_TOKENS}, lambda t: t = 'idiot')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20")
def lexical_simple_single(spark, sf_dir):
    return TI.search(_words(spark, sf_dir), "Idiot", 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, len(list_filter(t, lambda x: x IN ('the', 'license')))::BIGINT AS n FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'license')")
def lexical_simple_and(spark, sf_dir):
    return TI.holding(_words(spark, sf_dir), "the license").select(F.col("id").alias("doc_id"), "n")


#: Covers of two words: neighbouring positions of different words (positions from 1, weight 0.1).
_COVER = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), m AS (SELECT doc_id, t FROM d WHERE list_contains(t, 'the') AND list_contains(t, 'license')),
    p AS (SELECT doc_id, unnest(list_filter(list_transform(t, lambda x, i: {{'pos': i, 'w': x}}), lambda x: x.w IN ('the', 'license')), recursive := true) FROM m),
    n AS (SELECT doc_id, pos, w, lead(pos) OVER o AS next_pos, lead(w) OVER o AS next_w FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, round(sum(0.1 / (1 + (next_pos - pos - 1))), 6)::DOUBLE AS score FROM n WHERE next_w <> w GROUP BY doc_id ORDER BY round(sum(0.1 / (1 + (next_pos - pos - 1))), 6) DESC, doc_id LIMIT 50"""


@query(_COVER)
def lexical_cover_density(spark, sf_dir):
    scored = TI.search(_words(spark, sf_dir), "the license", None).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"""WITH d AS (SELECT doc_id, text, {_TOKENS} AS t FROM documents), h AS (
    SELECT doc_id, len(list_filter(t, lambda x: x = 'moron')) * 0.1 AS s FROM d WHERE list_contains(t, 'moron')
    UNION ALL SELECT doc_id, 0.01 FROM d WHERE NOT list_contains(t, 'moron') AND contains(lower(text), 'moron'))
    SELECT doc_id, round(s, 6) AS score FROM h ORDER BY s DESC, doc_id LIMIT 30""")
def lexical_ilike_fallback(spark, sf_dir):
    return TI.with_substring_fallback(_words(spark, sf_dir), table(spark, sf_dir, "documents"), "moron", 30).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT p_partkey, {_GRAMS.format('p_name')} AS g, {_GRAMS.format("'red widget'")} AS q FROM part),
    s AS (SELECT p_partkey, len(list_intersect(g, q)) * 1.0 / (len(g) + len(q) - len(list_intersect(g, q))) AS s FROM p)
    SELECT p_partkey, round(s::DOUBLE, 6) AS score FROM s WHERE s >= 0.3 ORDER BY s DESC, p_partkey LIMIT 50""")
def symbol_trigram(spark, sf_dir):
    hits = GI.similar(GI.gram_index(table(spark, sf_dir, "part"), "p_partkey", "p_name"), "red widget", 50)
    return hits.select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


_LEX = f"SELECT doc_id AS id, len(list_filter({_TOKENS}, lambda t: t = '{{0}}')) * 0.1 AS s FROM documents WHERE list_contains({_TOKENS}, '{{0}}')"


def _fused_sql(streams: dict[str, str], k: int, cap: int, limit: int) -> str:
    ranked = ", ".join(f"r{n} AS (SELECT id, '{n}' AS stream, row_number() OVER (ORDER BY s DESC, id) AS rank FROM ({q}) QUALIFY rank <= {cap})" for n, q in streams.items())
    every = " UNION ALL ".join(f"SELECT id::VARCHAR AS id, stream, rank FROM r{n}" for n in streams)
    ranks = ", ".join(f"coalesce(min(CASE WHEN stream = '{n}' THEN rank END), 0) AS {n}_rank" for n in streams)
    return f"WITH {ranked} SELECT id, round(sum(1.0 / ({k} + rank))::DOUBLE, 9) AS score, {ranks} FROM ({every}) GROUP BY id ORDER BY round(sum(1.0 / ({k} + rank))::DOUBLE, 9) DESC, id LIMIT {limit}"


def _best(fused, limit: int):
    rounded = fused.withColumn("score", F.round("score", 9))
    return rounded.orderBy(F.desc("score"), "id").limit(limit)


@query(_fused_sql({"vector": _NEAR.replace("e.vec_id,", "e.vec_id AS id,"), "lexical": _LEX.format("the")}, 60, 300, 25))
def rrf_two_way(spark, sf_dir):
    streams = {"vector": R.vector_stream(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 300), "lexical": TI.search(_words(spark, sf_dir), "the", 300)}
    return _best(R.fuse(streams), 25)


@query(_fused_sql({"a": _LEX.format("the"), "b": _LEX.format("license"), "c": _LEX.format("of")}, 60, 300, 25))
def rrf_three_way(spark, sf_dir):
    words = _words(spark, sf_dir)
    return _best(R.fuse({n: TI.search(words, w, 300) for n, w in (("a", "the"), ("b", "license"), ("c", "of"))}), 25)


@query(_fused_sql({"a": _LEX.format("the"), "b": _LEX.format("of")}, 10, 5, 25))
def rrf_capped(spark, sf_dir):
    words = _words(spark, sf_dir)
    return _best(R.fuse({n: TI.search(words, w, 300) for n, w in (("a", "the"), ("b", "of"))}, k=10, cap=5), 25)


_TITLE = "split_part(text, chr(10), 1)"
_HYBRID = _fused_sql(
    {
        "vector": _NEAR.replace("e.vec_id,", "e.vec_id AS id,"), "lexical": _LEX.format("license"),
        "symbol": f"SELECT doc_id AS id, len(list_intersect(g, q)) * 1.0 / (len(g) + len(q) - len(list_intersect(g, q))) AS s FROM (SELECT doc_id, {_GRAMS.format(_TITLE)} AS g, {_GRAMS.format(chr(39) + 'license' + chr(39))} AS q FROM documents) WHERE len(list_intersect(g, q)) * 1.0 / (len(g) + len(q) - len(list_intersect(g, q))) >= 0.05",
    }, 60, 300, 10,
)


@query(f"SELECT f.*, substring(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 1, 80) AS head FROM ({_HYBRID}) f LEFT JOIN documents d ON d.doc_id::VARCHAR = f.id")
def hybrid_search(spark, sf_dir):
    """Vectors, words and fuzzy titles (first lines) of documents, fused, with the head of each hit.

    Words and titles come from their indexes; only the texts of the hits are read.
    """
    docs = table(spark, sf_dir, "documents")
    titles = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    streams = {
        "vector": R.vector_stream(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 300),
        "lexical": TI.search(_words(spark, sf_dir), "license", 300),
        "symbol": GI.similar(GI.gram_index(titles, "doc_id", "title"), "license", 300, 0.05),
    }
    best = stored(_best(R.fuse(streams), 10), "hybrid-hits")  # ten rows, read twice below
    ids = [int(r[0]) for r in best.select("id").collect()]
    heads = docs.where(F.col("doc_id").isin(ids)).select(F.col("doc_id").cast("string").alias("id"), F.substring(T.collapse(F.col("text")), 1, 80).alias("head"))
    return best.join(heads, "id", "left")


@query(f"SELECT (count(*) >= 50 AND coalesce(max((rank <= 3 AND lower(name) = 'the')::INT), 0) = 0) AS wanted FROM (SELECT row_number() OVER (ORDER BY s DESC, id) AS rank, split_part(id::VARCHAR, '.', -1) AS name FROM ({_LEX.format('the')}) QUALIFY rank <= 300)")
def rerank_gate(spark, sf_dir):
    hits = R.ranked(TI.search(_words(spark, sf_dir), "the", 300)).select("rank", F.col("id").cast("string").alias("name"))
    return R.rerank_wanted(hits, "the")


@query("""WITH h AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'docs' END AS store, lang AS content, source AS signature, CASE WHEN l.quality = 1 THEN 'good' END AS summary FROM documents LEFT JOIN labels l USING (doc_id)),
    e AS (SELECT id, score, 0 AS place, 'code' AS layer, content AS body FROM h WHERE store = 'code' UNION ALL SELECT id, score, 1, 'ast', signature FROM h WHERE store = 'code'
    UNION ALL SELECT id, score, 2, 'ast_summary', summary FROM h WHERE store = 'code' AND summary IS NOT NULL UNION ALL SELECT id, score, 3, 'repo_doc', content FROM h WHERE store <> 'code')
    SELECT * FROM e ORDER BY score DESC, id, place LIMIT 60""")
def layer_fanout_topk(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    hits = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.when(F.col("doc_id") % 2 == 0, "code").otherwise("docs").alias("store"),
        F.col("lang").alias("content"), F.col("source").alias("signature"), F.when(F.col("quality") == 1, "good").alias("summary"),
    )
    return R.layers(hits, ("code", "ast", "ast_summary", "repo_doc"), 60)


_STOP = ", ".join(f"'{w}'" for w in T.TERM_STOPWORDS)


@query(f"""WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./:-]+'), lambda x: trim(lower(x), '._-:/')), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS a FROM benchmark)
    SELECT item_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:8], ' ') AS terms FROM t""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w FROM documents), p AS (SELECT *, length(w) AS n, instr(lower(w), 'license') - 1 AS f FROM c),
    s AS (SELECT *, CASE WHEN f < 0 THEN 0 ELSE greatest(0, f - 66) END AS s0 FROM p), e AS (SELECT *, least(n, s0 + 200) AS z FROM s)
    SELECT doc_id, n > 200 AS truncated, CASE WHEN n <= 200 THEN 0::BIGINT WHEN z - s0 < 200 AND s0 > 0 THEN greatest(0, z - 200) ELSE s0 END AS start FROM e""")
def snippet_window(spark, sf_dir):
    """Where each document's excerpt starts; a head that is cut shows an ellipsis."""
    out = T.with_snippet(table(spark, sf_dir, "documents"), "text", F.array(F.lit("license")), 200)
    right = F.when(F.col("truncated"), F.col("snippet").startswith("…") == (F.col("start") > 0)).otherwise(True)
    return out.select("doc_id", "truncated", F.when(right, F.col("start")).otherwise(-1).alias("start"))


#: The window of two terms in the collapsed text, its ends trimmed to words where a blank is near enough.
_SNIPPET = r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS w FROM documents),
    p AS (SELECT *, length(w) AS n, least(nullif(instr(lower(w), 'license'), 0), nullif(instr(lower(w), 'idiot'), 0)) - 1 AS f FROM c),
    s AS (SELECT *, CASE WHEN f IS NULL OR n <= 200 THEN 0 ELSE greatest(0, f - 66) END AS s0 FROM p), e AS (SELECT *, least(n, s0 + 200) AS z FROM s),
    r AS (SELECT *, CASE WHEN z - s0 < 200 AND s0 > 0 THEN greatest(0, z - 200) ELSE s0 END AS a FROM e), x AS (SELECT *, substring(w, a + 1, z - a) AS cut FROM r),
    y AS (SELECT *, length(cut) - instr(reverse(cut), ' ') AS sp FROM x),
    t AS (SELECT *, CASE WHEN z < n AND NOT regexp_matches(right(cut, 1), '[\s.!?;:,)\]"'']') AND instr(cut, ' ') > 0 AND sp > 0 AND sp >= length(cut) - 80 THEN rtrim(substring(cut, 1, sp)) WHEN z < n THEN rtrim(cut) ELSE cut END AS tail FROM y),
    h AS (SELECT *, instr(tail, ' ') - 1 AS b FROM t), g AS (SELECT *, CASE WHEN a > 0 THEN '…' || ltrim(CASE WHEN b > 0 AND b <= 80 THEN substring(tail, b + 2) ELSE tail END) ELSE tail END AS got FROM h)
    SELECT doc_id, CASE WHEN z < n THEN rtrim(got) || '…' ELSE got END AS snippet, n > 200 AS truncated FROM g"""


@query(_SNIPPET)
def snippets(spark, sf_dir):
    out = T.with_snippet(table(spark, sf_dir, "documents"), "text", F.array(F.lit("license"), F.lit("idiot")), 200)
    return out.select("doc_id", "snippet", "truncated")


@query("""WITH t AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, len(html) AS n FROM pages)
    SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id) AS place FROM t QUALIFY place <= 3""")
def linked_docs_top3(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", F.length("html").alias("n"))
    return P.capped_per_group(rows, "host", 3, F.desc("n"), "page_id").select("host", "page_id", "place")


@query("""WITH h AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, lower(text) AS t FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)
    SELECT id, round(score / max(score) OVER () + 0.1 * least(1.0, greatest(CASE WHEN contains(t, 'license') THEN 0.6 ELSE 0 END, CASE WHEN contains(t, 'worth_less') OR contains(t, 'worthless') OR contains(t, 'worth-less') THEN 0.9 ELSE 0 END)), 6) AS reranked FROM h""")
def domain_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), "text")
    concepts = spark.createDataFrame([("License", 0.6), ("WorthLess", 0.9)], "name string, importance double")
    out = R.domain_rerank(R.top(docs, 100), concepts, F.col("text"))
    return out.select("id", F.round("reranked", 6).alias("reranked"))


@query(f"SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token")
def index_tokens(spark, sf_dir):
    """Every token of the documents with its document and occurrence counts, from the index alone."""
    return TI.lexicon(_words(spark, sf_dir))


#: Covers of two words over a title (weight 1) and a text (0.1) laid end to end.
_FIELDS = f"""WITH d AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(lower(source || ' ' || split_part(text, chr(10), 1)), '[a-z0-9]+'), lambda x: {{'w': x, 'f': 1.0}}),
        list_transform({_TOKENS}, lambda x: {{'w': x, 'f': 0.1}})) AS t FROM documents),
    p AS (SELECT doc_id, unnest(list_filter(list_transform(t, lambda x, i: {{'pos': i, 'w': x.w, 'f': x.f}}), lambda x: x.w IN ('the', 'license')), recursive := true) FROM d),
    n AS (SELECT *, lead(pos) OVER o AS next_pos, lead(w) OVER o AS next_w, lead(f) OVER o AS next_f FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    s AS (SELECT doc_id, round(sum(2 / (1 / f + 1 / next_f) / (1 + (next_pos - pos - 1))), 6)::DOUBLE AS score FROM n WHERE next_w <> w GROUP BY doc_id)
    SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 40"""


@query(_FIELDS)
def lexical_two_fields(spark, sf_dir):
    """Words of a title and of a text, the title's worth ten times as much."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), "text")
    scored = TI.search(TI.token_index(docs, "doc_id", {"A": "title", "D": "text"}), "the license", None)
    return scored.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)


@query(f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'the license of ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 20 <> 11 OR doc_id % 10 = 3)
        UNION ALL SELECT doc_id + 1000000000, lang || ' license, the License' FROM documents WHERE doc_id % 10 = 4)
    SELECT doc_id, len(list_filter(t, lambda x: x IN ('the', 'license')))::BIGINT AS n FROM (SELECT doc_id, {_TOKENS} AS t FROM c) WHERE list_contains(t, 'the') AND list_contains(t, 'license')""")
def lexical_after_changes(spark, sf_dir):
    """The index after two rounds of changes: texts replaced and removed, then removed and added."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("doc_id % 10 = 3").select("doc_id", F.concat(F.lit("the license of "), "lang").alias("text"))
    index = TI.with_changes(_words(spark, sf_dir), first, "doc_id", removed=docs.where("doc_id % 20 = 11").select(F.col("doc_id").alias("id")))
    second = docs.where("doc_id % 10 = 4").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.concat("lang", F.lit(" license, the License")).alias("text"))
    index = TI.with_changes(index, second, "doc_id", removed=docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    return TI.holding(index, "License the").select(F.col("id").alias("doc_id"), "n")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'mer#00000001')")
def name_holds(spark, sf_dir):
    """A filter by part of a name: trigrams say where to look, the names decide."""
    rows = table(spark, sf_dir, "customer")
    return GI.holding(GI.gram_index(rows, "c_custkey", "c_name"), rows, "mer#00000001", "c_custkey", "c_name").select("c_custkey")


_PAIRS = """SELECT q.vec_id AS query, e.vec_id AS id, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS s
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) e JOIN (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 20 = 0) q ON e.vec_id <> q.vec_id"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query(f"SELECT query, rank, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM ({_PAIRS})) WHERE rank <= 10")
def vector_index_exact(spark, sf_dir):
    """The ten nearest of every twentieth vector with all lists probed: codes propose, vectors decide."""
    out = VI.search_all(VI.vector_index(table(spark, sf_dir, "embeddings")), _asked(spark, sf_dir), 10, VI.LISTS)
    return out.withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n_queries, least(10, (SELECT count(*) FROM embeddings) - 1) * count(*) AS n_wanted, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether the lists that the index probes hold nine tenths of the ten nearest of every twentieth vector."""
    index, asked = VI.vector_index(table(spark, sf_dir, "embeddings")), _asked(spark, sf_dir)
    exact = VI.search_all(index, asked, 10, VI.LISTS).select("query", "id")
    found = VI.search_all(index, asked, 10).select("query", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query", "id"], "left")
    return both.agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_wanted"), (F.sum("hit") >= 0.9 * F.count("*")).alias("enough"))




@query(f"SELECT doc_id, round(len(list_filter({_TOKENS}, lambda t: t IN {_LICENSES})) * 0.1, 6)::DOUBLE AS score FROM documents WHERE len(list_filter({_TOKENS}, lambda t: t IN {_LICENSES})) > 0 ORDER BY score DESC, doc_id LIMIT 100")
def lexical_english(spark, sf_dir):
    """A query of another form than the texts have, with a function word."""
    hits = TI.search(_words(spark, sf_dir, english=True), "the Licensing", 100)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_STORES = f"""WITH v AS (SELECT vec_id AS id, 'd' AS store, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_NEAR}) QUALIFY rank <= 300),
    y AS (SELECT id, 'c' AS store, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT p_partkey AS id, len(list_intersect(g, q)) * 1.0 / (len(g) + len(q) - len(list_intersect(g, q))) AS s FROM (SELECT p_partkey, {_GRAMS.format('p_name')} AS g, {_GRAMS.format("'widget'")} AS q FROM part)) WHERE s >= 0.3 QUALIFY rank <= 300),
    l AS (SELECT id, 'c' AS store, row_number() OVER (ORDER BY n DESC, id) AS rank FROM (SELECT p_partkey AS id, len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: t = 'widget')) AS n FROM part) WHERE n > 0 QUALIFY rank <= 300),
    x AS (SELECT id, 'd' AS store, row_number() OVER (ORDER BY n DESC, id) AS rank FROM (SELECT doc_id AS id, len(list_filter({_TOKENS}, lambda t: t = 'widget')) AS n FROM documents) WHERE n > 0 QUALIFY rank <= 300),
    f AS (SELECT store, id::VARCHAR AS id, round(sum(1.0 / (60 + rank))::DOUBLE, 9) AS score FROM (FROM v UNION ALL FROM y UNION ALL FROM l UNION ALL FROM x) GROUP BY store, id)
    SELECT CASE store WHEN 'c' THEN 'code' ELSE 'repo_docs' END AS store, id, score FROM f ORDER BY score DESC, store, id LIMIT 20"""


@query(_STORES)
def hybrid_stores(spark, sf_dir):
    """Parts as code and documents as documentation, ordered together."""
    rows = table(spark, sf_dir, "part")
    docs = H.Store(table(spark, sf_dir, "documents"), "doc_id", {"D": "text"}, table(spark, sf_dir, "embeddings"), "vec_id", tokens=_words(spark, sf_dir))
    parts = H.Store(rows, "p_partkey", {"A": "p_name"}, symbol="p_name", tokens=TI.token_index(rows, "p_partkey", {"A": "p_name"}), grams=GI.gram_index(rows, "p_partkey", "p_name"))
    return H.hybrid({"code": parts, "repo_docs": docs}, "widget", _probe(spark, sf_dir), 20).withColumn("score", F.round("score", 9))


@query(f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_NEAR}) QUALIFY rank <= 300), y AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM (SELECT p_partkey AS id, len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: t = 'widget')) AS n FROM part) WHERE n > 0 QUALIFY rank <= 300)
    SELECT store, id::VARCHAR AS id, round(1.0 / (60 + rank), 9)::DOUBLE AS score FROM (SELECT 'code' AS store, 0 AS place, id, rank FROM y UNION ALL SELECT 'repo_docs', 1, id, rank FROM v) ORDER BY score DESC, place, id::VARCHAR LIMIT 25""")
def hybrid_degraded(spark, sf_dir):
    """Streams that can't be planned are left out: documents lack the searched field, parts lack vectors of that name."""
    parts, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings")
    docs = H.Store(table(spark, sf_dir, "documents"), "doc_id", {"D": "no_such_column"}, vectors, "vec_id")
    code = H.Store(parts, "p_partkey", {"A": "p_name"}, parts, "p_partkey", "no_such_vector", tokens=TI.token_index(parts, "p_partkey", {"A": "p_name"}))
    return H.hybrid({"code": code, "repo_docs": docs}, "widget", _probe(spark, sf_dir), 25).withColumn("score", F.round("score", 9))


#: Each document is a source: its label source/lang/id, its readme the text.
_ROUTE = """WITH s AS (SELECT source || '/' || lang || '/' || doc_id AS label, coalesce(text, '') AS body FROM documents),
    q AS (SELECT unnest(['src1', 'license', 'apache', 'und', 'der']) AS t), N AS (SELECT count(*) AS n FROM s),
    m AS (SELECT label, t, contains(lower(label), t) AS in_label FROM s, q WHERE contains(lower(label || chr(10) || substring(body, 1, 2000)), t)),
    i AS (SELECT q.t, CASE WHEN count(m.label) = 0 THEN 0 ELSE ln((any_value(n) + 1.0) / (count(m.label) + 1)) END AS idf FROM q LEFT JOIN m USING (t), N GROUP BY q.t),
    r AS (SELECT label, sum(idf) AS hit, count(*) AS c, sum(in_label::INT) AS nl FROM m JOIN i USING (t) GROUP BY label), w AS (SELECT sum(idf) AS total FROM i),
    z AS (SELECT s.label, hit, round(least(1.0, coalesce(CASE WHEN total > 0 THEN hit / total ELSE c / 5.0 END, 0) * (1 + 0.5 * coalesce(nl, 0) / 5)), 6) AS score FROM s LEFT JOIN r USING (label), w)
    SELECT label, score {0} FROM z WHERE {1} ORDER BY score DESC, label LIMIT 12"""


def _sources(spark, sf_dir):
    label = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(label.alias("label"), F.coalesce("text", F.lit("")).alias("body"), F.lit("").alias("symbols"))


@query(_ROUTE.format("", "hit IS NOT NULL"))
def route_sources(spark, sf_dir):
    return routing.route_repositories(_sources(spark, sf_dir), "src1 license Apache und der", 12, readme="body").select("label", F.round("score", 6).alias("score"))


#: The same for collections: headings are the first lines, bodies match by stemmed words.
_BODIES = _ROUTE.replace("contains(lower(label || chr(10) || substring(body, 1, 2000)), t)", f"contains(lower(label || chr(10) || split_part(body, chr(10), 1)), t) OR list_has_any({_TOKENS.replace('text', 'body')}, CASE t WHEN 'license' THEN {list(_LICENSES)} WHEN 'apache' THEN ['apache', 'apaches'] ELSE [t] END)")


def _collections(spark, sf_dir):
    """(collections, what their documents' words match)."""
    rows = _sources(spark, sf_dir).select("label", F.split_part("body", F.lit("\n"), F.lit(1)).alias("headings"))
    of = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("label"))
    return rows, routing.body_matches(_words(spark, sf_dir, english=True), "src1 license Apache und der", of)


@query(_BODIES.format(", score < 0.3 AS weak", "true"))
def route_collections_always(spark, sf_dir):
    """Collections by label, headings and the words of their documents, whose forms are looked up in the index."""
    rows, bodies = _collections(spark, sf_dir)
    return routing.route_collections(rows, "src1 license Apache und der", 12, bodies=bodies).select("label", F.round("score", 6).alias("score"), "weak")


_WHY = _ROUTE.format("", "hit IS NOT NULL").replace("    SELECT label, score  FROM z", "    , b AS (SELECT label, score FROM z") + """)
    SELECT label, string_agg(CASE WHEN idf > 0 AND idf >= 0.95 * top THEN t || ' (rare)' ELSE t END, ', ' ORDER BY t) AS why
    FROM (SELECT label, t, idf, max(idf) OVER (PARTITION BY label) AS top, row_number() OVER (PARTITION BY label ORDER BY t) AS k FROM m JOIN i USING (t) WHERE label IN (SELECT label FROM b)) WHERE k <= 4 GROUP BY label"""


@query(_WHY)
def route_explained(spark, sf_dir):
    return routing.explained(routing.route_repositories(_sources(spark, sf_dir), "src1 license Apache und der", 12, readme="body")).select("label", "why")


@query("WITH a AS (" + _ROUTE.format("", "hit IS NOT NULL").replace("LIMIT 12", "LIMIT 5") + "), b AS (" + _BODIES.format("", "true").replace("LIMIT 12", "LIMIT 4") + ") SELECT 'repository' AS pool, label, score FROM a UNION ALL SELECT 'collection', label, score FROM b")
def route_pools(spark, sf_dir):
    """Repositories and collections are ranked by themselves and stand side by side."""
    collections, bodies = _collections(spark, sf_dir)
    return routing.pools(_sources(spark, sf_dir), collections, "src1 license Apache und der", 5, 4, bodies=bodies, readme="body").select("pool", "label", F.round("score", 6).alias("score"))
