"""Sinks that write once, sealed archives, file manifests and topology versions."""

import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from faultline.operators import validation as V
from faultline.operators.tables import committed, scratch
from faultline.sources import sinks as K
from faultline.streaming import windows as W

SCHEMA = "id string, body string, score double"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def outcome(sink, spark):
    return sorted((r.id, r.body, r.outcome) for r in sink.outcomes(spark).collect())


def test_identical_rewrites_pass_and_differing_ones_are_refused(spark):
    sink = K.UniqueSink(scratch(spark, "sink"), ["id"])
    sink(rows(spark, ("a", "x", 1.0), ("b", "y", None), ("c", "1", 0.0), ("c", "2", 0.0), ("d", "z", 1.0), ("d", "z", 1.0)), 0)
    assert outcome(sink, spark) == [("a", "x", "written"), ("b", "y", "written"), ("c", "1", "conflict"), ("c", "2", "conflict"), ("d", "z", "written")]
    sink(rows(spark, ("a", "x", 1.0), ("b", "y", 0.0), ("c", "1", 0.0)), 1)
    assert sorted((r.id, r.body) for r in sink.written(spark).collect()) == [("a", "x"), ("b", "y"), ("c", "1"), ("d", "z")]
    assert outcome(sink, spark)[1:2] == [("a", "x", "written")] and ("b", "y", "conflict") in outcome(sink, spark)
    sink(rows(spark, ("e", "late", 1.0)), 1)  # a batch that was committed
    assert sink.written(spark).count() == 4
    strict = K.UniqueSink(sink.folder, ["id"], strict=True)
    with pytest.raises(K.Conflict):
        strict(rows(spark, ("a", "other", 1.0)), 2)
    strict(rows(spark), 3)
    assert strict.written(spark).count() == 4


def test_a_stream_that_fails_before_its_commit_writes_once(spark):
    folder, failed = scratch(spark, "sink"), []

    def stop(batch_id):
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    sink = K.UniqueSink(f"{folder}/t", ["id"], before_commit=stop)
    rows(spark, ("a", "x", 1.0), ("b", "y", 2.0)).write.parquet(f"{folder}/in")
    for _ in range(2):
        try:
            W.drained(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/c", sink)
        except Exception as error:
            assert "lost" in str(error) and sink.outcomes(spark) is None
    assert committed(spark, sink.folder) == [0] and sink.written(spark).count() == 2


def test_an_archive_is_sealed_once_and_shows_damage(spark):
    folder = scratch(spark, "archive")
    data = spark.createDataFrame([(w, k, i * 1.5) for w in range(4) for k in "ab" for i in range(3)], "win long, kind string, value double")
    archive = K.WindowArchive(folder, "win", "kind")
    with pytest.raises(K.Conflict):
        archive.seal(data.where("win <> 2"))
    archive.seal(data)
    archive.seal(data.repartition(5).orderBy(F.desc("value")))  # the same rows in another order
    assert {(r.win, r.n, r.kinds) for r in archive.manifest(spark).collect()} == {(w, 6, 2) for w in range(4)} and archive.verify(spark).count() == 0
    for other in (data.withColumn("value", F.when(F.col("win") == 1, F.lit(9.0)).otherwise(F.col("value"))), data.where("win < 3"), data.unionByName(data.where("win = 0"))):
        with pytest.raises(K.Conflict):
            archive.seal(other)
    data.where("win = 3 and value > 0").drop("win").write.mode("overwrite").parquet(f"{folder}/rows/win=3")
    data.where("win = 0").drop("win").write.parquet(f"{folder}/rows/win=7")
    assert {(r.win, r.issue) for r in archive.verify(spark).collect()} == {(3, "changed"), (7, "unlisted")}


def test_a_manifest_shows_damaged_missing_and_misplaced_files(spark, tmp_path):
    base = tmp_path / "set (1)"
    (base / "labels").mkdir(parents=True)
    files = {"a.bin": b"one", "b.bin": b"two", "c.bin": b"", "labels/l.bin": b"truth"}
    for name, content in files.items():
        (base / name).write_bytes(content)
    found = K.file_manifest(spark, str(base))
    assert {(r.name, r.bytes, r.sha256) for r in found.collect()} == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if c}
    listed = spark.createDataFrame([(n, len(c), hashlib.sha256(c).hexdigest(), "input") for n, c in files.items()] + [("gone.bin", 3, "0", "input"), ("a.bin", 3, hashlib.sha256(b"one").hexdigest(), "input")], "name string, bytes long, sha256 string, role string")
    (base / "b.bin").write_bytes(b"TWO")
    (base / "c.bin").write_bytes(b"longer")
    (base / "new.bin").write_bytes(b"n")
    issues = K.manifest_issues(listed, K.file_manifest(spark, str(base)), ["labels"])
    assert {(r.name, r.issue) for r in issues.collect()} == {("b.bin", "damaged"), ("c.bin", "size"), ("gone.bin", "missing"), ("new.bin", "unlisted"), ("a.bin", "listed_twice"), ("labels/l.bin", "labels_in_inputs")}


def test_files_beyond_the_limit_are_told_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"12345")
    monkeypatch.setattr(K, "MOST_BYTES", 4)
    found = K.file_manifest(spark, str(tmp_path / "d"))
    listed = spark.createDataFrame([("a", 5, "0", "input")], "name string, bytes long, sha256 string, role string")
    assert [(r.name, r.issue) for r in K.manifest_issues(listed, found, []).collect()] == [("a", "unread")]


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
from faultline.sources import sinks as K
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
for r in K.file_manifest(spark, sys.argv[1]).collect():
    print("FOUND", r.name, r.bytes, r.sha256)
"""


def test_a_file_larger_than_the_heap_is_hashed_as_a_stream(tmp_path):
    size, digest = 640 << 20, hashlib.sha256()
    for name in ("a", "b"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)  # takes no room on disk
    for _ in range(640):
        digest.update(bytes(1 << 20))
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], capture_output=True, text=True, env=dict(os.environ), timeout=300)
    found = sorted(line for line in run.stdout.splitlines() if line.startswith("FOUND"))
    assert found == [f"FOUND {name} {size} {digest.hexdigest()}" for name in ("a", "b")], run.stderr[-2000:]


def test_a_file_of_more_than_a_gibibyte_has_its_hash(spark, tmp_path):
    digest = hashlib.sha256()
    with open(tmp_path / "large", "wb") as f:
        f.truncate((1 << 30) + 3)  # takes no room on disk
    for size in [1 << 20] * 1024 + [3]:
        digest.update(bytes(size))
    found = K.file_manifest(spark, str(tmp_path))
    assert [(r.name, r.bytes, r.sha256) for r in found.collect()] == [("large", (1 << 30) + 3, digest.hexdigest())]


def test_a_manifest_takes_paths_as_they_are(spark, tmp_path):
    files = {"a%20 b#c.bin": b"one", "d=1/ü+?.gz": b"not packed", "e": bytes(range(256)) * 9}
    (tmp_path / "m" / "d=1").mkdir(parents=True)
    for name, content in files.items():
        (tmp_path / "m" / name).write_bytes(content)
    found = K.file_manifest(spark, str(tmp_path / "m"))
    assert {(r.name, r.bytes, r.sha256) for r in found.collect()} == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_topology_versions(spark):
    parts = spark.createDataFrame([("s1", "e:a>b"), ("s1", "e:b>c"), ("s1", "e:a>b"), ("s2", "e:b>c"), ("s2", "e:a>b")], "snapshot_id string, part string")
    prints = {r.snapshot_id: r.print for r in V.structure_prints(parts, "snapshot_id", "part").collect()}
    assert prints["s1"] == prints["s2"]
    snapshots = [("a", 0, 10, "p", "p"), ("b", 10, 30, "p", "q"), ("c", 15, 20, "p", "p"), ("d", 25, 40, "p", None), ("a", 40, 40, "p", "p")]
    got = V.version_issues(spark.createDataFrame(snapshots, "snapshot_id string, valid_from long, valid_to long, print string, recorded string")).collect()
    assert {(r.snapshot_id, r.valid_from, r.issue) for r in got} == {("a", 0, "repeated_id"), ("a", 40, "repeated_id"), ("a", 40, "empty_interval"), ("b", 10, "changed_structure"), ("c", 15, "overlap"), ("d", 25, "overlap"), ("d", 25, "changed_structure")}
