"""Tables that several steps read: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path in the shared folder that the session names (spark.checkpoint.dir), or beside a local session's temporary files."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: later steps read it instead of planning and computing it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_width(table: DataFrame, rows: int = 1 << 19) -> int:
    """Partitions that hold about ``rows`` rows of a table read from files (its count is in their footers), so that a task's memory does not grow with it."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if it is not there."""
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file that says that all beside it is written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The batches (folders batch=<id>) of a folder whose mark is there."""
    return [int(n.partition("=")[2]) for n in children(spark, folder) if n.startswith("batch=") and exists(spark, f"{folder}/{n}/_COMMITTED")]
