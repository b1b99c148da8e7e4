"""Tables derived from a source once and read by many queries, such as postings.

An index is a Parquet table in the shared folder, named after what it holds and after the files of its source: their
names, lengths and times of change. A source that changes gets a new index; its old one stays until ``clear_indexes``.
An index is written beside its place and moved there when it is whole, so sessions that build the same one don't meet.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.shared import remove, shared_dir


def _files(source: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files that a DataFrame reads."""
    spark = source.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in sorted(source.inputFiles()):
        at = path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def indexes_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/indexes"


def kept(source: DataFrame, name: str, build: Callable[[], DataFrame], /, by: tuple[str, ...] = (), sort: tuple[str, ...] = (), **parameters) -> DataFrame:
    """The table that ``build`` gives for a source, written once for its files, what is done with them, and the parameters.

    by: columns whose values become folders, so that a query which names them reads only these; sort: order inside a file. A source that reads no files, as
    one made of rows in memory, gets a table of its own each time.
    """
    spark = source.sparkSession
    files = _files(source)
    mark = hashlib.sha256(json.dumps([files or uuid.uuid4().hex, source.semanticHash(), parameters, by, sort], sort_keys=True).encode()).hexdigest()[:24]
    place = f"{indexes_dir(spark)}/{name}-{mark}"
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        beside = f"{place}-{uuid.uuid4().hex}"
        table = build()
        table = table.sortWithinPartitions(*by, *sort) if by or sort else table
        (table.write.partitionBy(*by) if by else table.write).option("compression", "zstd").parquet(beside)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), at) or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(place, beside.rsplit("/", 1)[1])):
            remove(spark, f"{place}/{beside.rsplit('/', 1)[1]}")  # another session was first: what came to lie inside its table goes
            remove(spark, beside)
    return spark.read.parquet(place)


def clear_indexes(spark: SparkSession) -> None:
    """Remove all indexes of the shared folder."""
    remove(spark, indexes_dir(spark))
