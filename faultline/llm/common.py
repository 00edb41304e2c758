"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular expression class body; everything else is part of a word.
WS = r"\x20\x09-\x0D"
#: Most texts in an Arrow batch (Spark's default is 10,000).
BATCH_ROWS = 2000
_TRIM = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine, block: int = 256) -> Column:
    """The combinations of each array element with all before it (combine is associative), empty for an empty array, null for null.

    Arrays grow by copies, so they are grown in blocks only; the blocks' last values are combined alike and then joined in.
    """

    def grown(a: Column) -> Column:
        return F.aggregate(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def joined(blocks: Column) -> Column:
        tops = grown(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))  # null for an empty last block
        shift = lambda t, b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(t, k - 1), x)))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda b, k: shift(t, b, k))))

    starts = lambda a: F.sequence(F.lit(0), F.floor(F.size(a) / block).cast("int"))
    return let(values, lambda a: let(F.transform(starts(a), lambda i: grown(F.slice(a, i * block + 1, F.lit(block)))), joined))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Spark hand whole texts to Python ``rows`` at a time at most, here and later in the session: the JVM's buffers and the worker's copies of a batch count together."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or on a local master a temporary one."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root := tempfile.mkdtemp(prefix="spark-"))
        root = sc.getCheckpointDir()
    return root


def written(df: DataFrame, few: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives executors.

    few: a table much smaller than its input, written by an eighth of the shuffle's tasks, so that it is not a heap of tiny files.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(1, shuffle_width(spark) // 8))
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a frame made by written() that nothing needs any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bucket_of(value: Column, splits: list) -> Column:
    """Number of the sorted splits that are <= value, as a balanced tree of comparisons (null value: 0)."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(splits[mid]), node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(splits))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
