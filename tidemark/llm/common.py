"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in local mode."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def settle(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; cuts the lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, to be broadcast if it has no more than `rows` rows, as they are: for settled tables of a few numbers a row."""
    return F.broadcast(df) if df.count() <= rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of stages that are settled and no longer referred to, which it does when garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends whole texts to Python a thousand at a time, unless the session asks for a number of its own: a batch of texts is
    in memory several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def salts(spark: SparkSession, least: int = 64) -> int:
    """Into how many parts one key's rows are dealt: no fewer than the shuffle has partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to these that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
