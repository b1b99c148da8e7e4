"""Tables that several jobs of one query read, kept where every executor can see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, as in tests, where the session names no folder.
LOCAL_DIR = "/tmp/checkpoints"

_kept: dict[str, list[tuple[str, str]]] = {}  # application -> (path, table name or "") of what was stored


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a session on one machine may do without."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(at := LOCAL_DIR)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.setdefault(spark.sparkContext.applicationId, []).append((path, ""))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and losing an
    executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """stored(), bucketed and sorted by a key: joins on it move only their other side. For tables that many rounds join."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "stored_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    _kept[spark.sparkContext.applicationId].append(("", table))
    return spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_stored(spark: SparkSession) -> int:
    """Remove everything that this session stored; call it once the results are written. Gives the number of tables."""
    kept = _kept.pop(spark.sparkContext.applicationId, [])
    for path, table in kept:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        else:
            remove(spark, path)
    return sum(1 for path, _ in kept if path)
