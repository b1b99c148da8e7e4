"""The given tables as the engine's own: documents, code nodes and edges, usage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def instants(df: DataFrame) -> DataFrame:
    """df with zoneless timestamps as instants of the session's zone."""
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t == "timestamp_ntz"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return instants(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt anew by key over all partitions of a shuffle. For work that is dear for each row: a table of many short rows is a
    small file, which is read in one or two tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parts_as_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code nodes: type by size, file by brand."""
    kind = F.element_at(F.array(*map(F.lit, ("module", "class", "function", "method", "interface"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("qualified_name"),
        kind.alias("node_type"), F.col("p_brand").alias("file_path"), F.col("p_size").cast("long").alias("start_line"), F.when(F.col("p_partkey") % 2 == 0, "python").otherwise("go").alias("language"),
    )


#: The same in SQL.
NODES_SQL = """SELECT p_partkey AS id, p_name AS name, lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '_') AS qualified_name,
    (['module','class','function','method','interface'])[p_size % 5 + 1] AS node_type, p_brand AS file_path, p_size::BIGINT AS start_line,
    CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'go' END AS language FROM part"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts: a part calls the parts of the same order's next line."""
    a, b = (table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(f"{x}_line"), F.col("l_partkey").alias(x)) for x in ("src", "dst"))
    joined = a.join(b.withColumn("src_line", F.col("dst_line") - 1), ["l_orderkey", "src_line"])
    return joined.where("src != dst").select("src", "dst", F.lit("calls").alias("type")).distinct()


EDGES_SQL = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, 'calls' AS type FROM lineitem a
    JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: duration from value, tokens and cost from the payload's k."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "error", "error").when(k % 7 == 0, "empty").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("tool"), status.alias("status"), F.when(k % 7 == 0, 0).otherwise(k).cast("long").alias("result_count"),
        F.round(F.col("value") * 10).cast("long").alias("duration_ms"), k.alias("tokens"), F.when(F.col("event_type") != "view", k * 3).alias("cost_micros"), F.when(k % 2 == 0, "mcp").otherwise("rest").alias("source"),
    )


LOGS_SQL = """SELECT event_id AS id, user_id, ts AS created_at, event_type AS tool, k,
    CASE WHEN event_type = 'error' THEN 'error' WHEN k % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN k % 7 = 0 THEN 0 ELSE k END AS result_count,
    round(value * 10)::BIGINT AS duration_ms, k AS tokens, CASE WHEN event_type <> 'view' THEN k * 3 END AS cost_micros, CASE WHEN k % 2 = 0 THEN 'mcp' ELSE 'rest' END AS source
    FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events)"""
