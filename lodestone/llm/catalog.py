"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, divergence, licenses, mixing, neardup, neighbours, pii, quality, rules, toxicity, tries, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_warc, op3_pii, op4_toxicity, op5_urls, op6_mixing, op7_neardup, op8_decontamination, op9_licenses, op10_rules, op11_trie, op12_divergence, op13_neighbours)}


#: The SQL twins; the other queries learn, iterate or search and are tested by brute force.
ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM w""",
    "op11_trie": r"""
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, {'role': role, 'text': text} AS x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text)) AS k FROM t),
        own AS (SELECT c, list(x ORDER BY k) AS xs FROM o GROUP BY c),
        h AS (SELECT c, xs, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
              lambda r, b: list_reduce([xor(r, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
              lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT) % 4 AS h FROM own),
        rebuilt AS (SELECT a.c, list_concat(coalesce(b.xs[1:a.h], []), a.xs[a.h + 1:]) AS xs FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 20),
        m AS (SELECT c, len(xs) AS n, unnest(range(0, len(xs) + 1)) AS d, xs FROM rebuilt),
        nodes AS (SELECT d, xs[1:d] AS path, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY d, xs[1:d]),
        ch AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
        full_n AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[n.d].text, '[^\x20\x09-\x0D]+')) END AS saved
                   FROM nodes n LEFT JOIN ch ON n.d = ch.d AND n.path = ch.path),
        up AS (SELECT unnest(range(0, d + 1)) AS a, path, n_children, saved FROM full_n),
        subtree AS (SELECT a AS d, path[1:a] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY a, path[1:a])
        SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
        FROM full_n n JOIN subtree s ON s.d = n.d AND s.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        o AS (SELECT r, lang, source, unnest(t) AS item FROM d),
        k AS (SELECT lang, item FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, item, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, item) GROUP BY ALL),
        full_c AS (SELECT g.lang, g.source, k.item, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
        p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_c JOIN v USING (lang)),
        l AS (SELECT lang, item, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
        q AS (SELECT lang, item, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT p.lang, p.source, 'term' AS part, p.item, (p - q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.item = q.item WHERE p.n > 0 AND p > q),
        ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op7_neardup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]))
                                  WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id
              WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
        m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
