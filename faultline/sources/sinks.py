"""Sinks that write a thing once: keyed reports with a check for conflicts, sealed archives of windows, and file manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.tables import children, committed, exists, mark

#: For callers who want it: larger files are listed without a hash. By default every file is hashed.
MOST_BYTES: int | None = None


class Conflict(ValueError):
    """Something was to be written again with other content."""


def content_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values as JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


class UniqueSink:
    """Rows told apart by ``key``: each key is written once. Use as a foreachBatch function, or call it with a DataFrame and a batch id.

    A key that comes again with the same content is accepted and not written again; with other content it is a conflict, as is a
    key with several contents in one batch: none of them is written. Conflicts are kept beside the rows, and raise Conflict once
    all is committed if ``strict``. A batch id that is committed is left alone, one that is not is written again from the start.
    content names the columns that make up the content (all but the key); others are carried along.
    """

    def __init__(self, folder: str, key: list[str], content: list[str] | None = None, strict: bool = False, before_commit: Callable[[int], None] = lambda _: None):
        self.folder, self.key, self.content, self.strict, self.before_commit = folder, key, content, strict, before_commit

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in committed(spark, self.folder):
            return
        content = self.content or [c for c in batch.columns if c not in self.key]
        rows = batch.withColumn("_hash", content_hash(content)).dropDuplicates([*self.key, "_hash"])
        per_key = rows.groupBy(*self.key).agg(F.count("*").alias("_contents"))
        known = self.written(spark)
        kept = known.select(*self.key, F.col("_hash").alias("_kept")) if known is not None else per_key.select(*self.key, F.lit(None).cast("string").alias("_kept")).limit(0)
        judged = rows.join(per_key, self.key).join(kept, self.key, "left")
        outcome = F.when(F.col("_contents") > 1, "conflict").when(F.col("_kept").isNull(), "written").when(F.col("_kept") == F.col("_hash"), "same").otherwise("conflict")
        path = f"{self.folder}/batch={batch_id}"
        judged.withColumn("outcome", outcome).drop("_contents", "_kept").write.mode("overwrite").partitionBy("outcome").parquet(path)
        self.before_commit(batch_id)
        mark(spark, f"{path}/_COMMITTED")
        found = self.outcomes(spark) if self.strict else None
        if found is not None and (n := found.where((F.col("batch") == batch_id) & (F.col("outcome") == "conflict")).count()):
            raise Conflict(f"batch {batch_id} has {n} rows whose key was written with other content")

    def outcomes(self, spark: SparkSession) -> DataFrame | None:
        """All distinct rows that came, with their batch and outcome (written, same, conflict): one scan; None before any came."""
        paths = [f"{self.folder}/batch={i}" for i in committed(spark, self.folder)]
        paths = [p for p in paths if any(n.startswith("outcome=") for n in children(spark, p))]
        return spark.read.option("basePath", self.folder).parquet(*paths) if paths else None

    def written(self, spark: SparkSession) -> DataFrame | None:
        out = self.outcomes(spark)
        return None if out is None else out.where("outcome = 'written'").drop("outcome", "batch")


def window_sums(rows: DataFrame, window: str, kind: str) -> DataFrame:
    """(window, kind, n, h0..h3): rows and an order-free hash of each window and kind, as sums of four pieces of the rows' hashes."""
    digest = content_hash(sorted(rows.columns))
    piece = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"h{i}")
    return rows.groupBy(window, kind).agg(F.count("*").alias("n"), *[piece(i) for i in range(4)])


def manifest(sums: DataFrame, window: str, kind: str) -> DataFrame:
    """(window, n, kinds, content): a manifest row of each window from its sums."""
    text = lambda: F.concat_ws("|", kind, F.col("n").cast("string"), *[F.col(f"h{i}").cast("string") for i in range(4)])
    return sums.groupBy(window).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(text()))), 256).alias("content"))


class WindowArchive:
    """An archive of contiguous windows that is written once. Rows have a window number and a kind."""

    def __init__(self, folder: str, window: str, kind: str):
        self.folder, self.window, self.kind = folder, window, kind

    def seal(self, rows: DataFrame) -> None:
        """Writes rows and manifest, if the windows are without gaps. The same content again changes nothing; other content raises Conflict."""
        spark = rows.sparkSession
        fresh = manifest(window_sums(rows, self.window, self.kind), self.window, self.kind)
        span = fresh.agg(F.count("*").alias("n"), F.min(self.window).alias("lo"), F.max(self.window).alias("hi")).first()
        if span["n"] and span["hi"] - span["lo"] + 1 != span["n"]:
            raise Conflict(f"windows {span['lo']} to {span['hi']} are {span['n']} only")
        if exists(spark, f"{self.folder}/_SEALED"):
            if differing := self._differing(self.manifest(spark), fresh).count():
                raise Conflict(f"the archive is sealed; {differing} windows differ")
            return
        rows.write.mode("overwrite").partitionBy(self.window).parquet(f"{self.folder}/rows")
        fresh.write.mode("overwrite").parquet(f"{self.folder}/manifest")
        mark(spark, f"{self.folder}/_SEALED")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/manifest")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")

    def verify(self, spark: SparkSession) -> DataFrame:
        """(window, issue): windows whose rows are not those of the manifest: missing, unlisted or changed."""
        return self._differing(self.manifest(spark), manifest(window_sums(self.rows(spark), self.window, self.kind), self.window, self.kind))

    def _differing(self, listed: DataFrame, found: DataFrame) -> DataFrame:
        a, b = listed.select(self.window, F.col("content").alias("listed")), found.select(self.window, F.col("content").alias("found"))
        issue = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("found"), "changed")
        return a.join(b, self.window, "full").select(self.window, issue.alias("issue")).where("issue is not null")


def streamed_sha256(spark: SparkSession, path: Column) -> Column:
    """SHA-256 of the file at each path, in any store that Spark reads: the row's task passes it through the digest in small pieces, so no task holds a file.

    SQL has no function on streams, so DigestUtils.sha256Hex(new AutoCloseInputStream(path.getFileSystem(conf).open(path))) is put together from Spark's
    expressions on objects. The stream is closed at its end.
    """
    jvm = spark.sparkContext._jvm
    expressions, utils = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.classic.ExpressionUtils
    loaded = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
    of = lambda name: jvm.org.apache.spark.sql.types.ObjectType(loaded(name))
    seq, none = jvm.PythonUtils.toSeq, jvm.scala.Option.apply(None)
    call = lambda target, method, kind, *args: expressions.objects.Invoke(target, method, kind, seq([*args]), seq([]), True, True, True)
    static = lambda name, method, kind, *args: expressions.objects.StaticInvoke(loaded(name), kind, method, seq([*args]), seq([]), True, True, True, none)
    new = lambda name, *args: expressions.objects.NewInstance(loaded(name), seq([*args]), seq([]), True, of(name), none)
    settings = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    conf = call(expressions.Literal.fromObject(settings, of("org.apache.spark.util.SerializableConfiguration")), "value", of("org.apache.hadoop.conf.Configuration"))
    file = new("org.apache.hadoop.fs.Path", call(utils.expression(path._jc), "toString", of("java.lang.String")))
    stream = call(call(file, "getFileSystem", of("org.apache.hadoop.fs.FileSystem"), conf), "open", of("org.apache.hadoop.fs.FSDataInputStream"), file)
    digest = static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex", of("java.lang.String"), new("org.apache.commons.io.input.AutoCloseInputStream", stream))
    return Column(utils.column(static("org.apache.spark.unsafe.types.UTF8String", "fromString", jvm.org.apache.spark.sql.types.DataType.fromDDL("string"), digest)))


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files of a folder and below, whatever their size (but see MOST_BYTES). Contents are
    read and hashed by the executors, a file as a stream. Spark passes over files without content; a listed file of 0 bytes is therefore never missed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", r"^.*?" + "/" + _last(folder) + "/", "")
    digest = streamed_sha256(spark, F.col("path"))
    if MOST_BYTES is not None:
        digest = F.when(F.col("length") <= MOST_BYTES, digest)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), digest.alias("sha256"))


def _last(folder: str) -> str:
    import re

    return re.escape(folder.rstrip("/").rpartition("/")[2])


def manifest_issues(listed: DataFrame, found: DataFrame, labels: list[str]) -> DataFrame:
    """(name, issue) of listed files (name, bytes, sha256, role) against those found: missing, unlisted, size, damaged, unread, listed_twice, and labels among the inputs."""
    once = listed.groupBy("name").agg(F.count("*").alias("times"), F.first("bytes").alias("lb"), F.first("sha256").alias("lh"), F.max("role").alias("role"))
    both = once.join(found.select("name", F.col("bytes").alias("fb"), F.col("sha256").alias("fh"), F.lit(True).alias("there")), "name", "full")
    tests = [
        (F.col("there").isNull() & (F.col("lb") > 0), "missing"), (F.col("times").isNull(), "unlisted"), (F.col("times") > 1, "listed_twice"), (F.col("lb") != F.col("fb"), "size"),
        ((F.col("lb") == F.col("fb")) & (F.col("lh") != F.col("fh")), "damaged"), (F.col("there") & F.col("fh").isNull(), "unread"), ((F.col("role") == "input") & F.substring_index("name", "/", 1).isin(*labels), "labels_in_inputs"),
    ]
    found_ = F.array_compact(F.array(*[F.when(test, issue) for test, issue in tests]))
    return both.select("name", F.explode(found_).alias("issue"))
