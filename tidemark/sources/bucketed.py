"""Tables that many jobs join on one key: written once, bucketed and sorted by it, and read without an exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.stages import settle


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """(path, bytes, last change) of each table: what tells whether a stored table still stands for them."""
    out = []
    for where in paths:
        path, fs = _path(spark, where)
        out.append((where, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return fs.exists(path)


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    path, fs = _path(spark, where)
    fs.delete(path, True)


def stored_dir(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        settle(spark.range(1))  # settles where checkpoints go
    return f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, key: str, buckets: int | None = None, dealt: bool = False) -> tuple[DataFrame, str]:
    """(df as a table bucketed and sorted by `key`, its folder). Tables of as many buckets join and group by the key where they lie.

    The session's shuffle partitions are the number of buckets unless it is given. Rows with null keys share a bucket; a table
    without rows has none. One task writes a bucket, so a bucket is one file. dealt: df lies in as many partitions by the key already,
    and is not dealt out again; if it does not, a bucket is several files.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where, name = stored_dir(spark), f"stored_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", where).saveAsTable(name)
    return spark.table(name), where


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once beside the checkpoints in columns: for large stages, which as a checkpoint are rows as in memory."""
    where = stored_dir(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
