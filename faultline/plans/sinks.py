"""Queries for sinks that write once, archives and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import validation as V
from faultline.operators.tables import scratch, written
from faultline.sources import sinks as K

from . import learner
from .streams import replayed_through
from .views import SQL, query

#: A user's day is a report on its first metric; what comes in each quarter of the day is one delivery.
SQL["v_reports"] = "SELECT DISTINCT instance, CAST(floor(timestamp/86400) AS BIGINT) AS day, CAST(floor(timestamp/21600) AS BIGINT)%4 AS delivery, metric FROM v_metrics"


@query("src_22_unique_sink", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY instance, day, delivery) AS contents FROM v_reports), f AS (SELECT instance, day, arg_min(metric, delivery) AS metric0, min(delivery) AS first FROM n WHERE contents=1 GROUP BY 1,2)
 SELECT outcome, delivery, count(*) AS n FROM (SELECT delivery, CASE WHEN contents>1 OR first IS NULL OR delivery<first THEN 'conflict' WHEN delivery=first THEN 'written' WHEN metric=metric0 THEN 'same' ELSE 'conflict' END AS outcome FROM n LEFT JOIN f USING (instance, day)) GROUP BY 1,2""")
def _(v):
    m = v.metrics().select("instance", F.floor(F.col("timestamp") / 86400).alias("day"), (F.floor(F.col("timestamp") / 21600) % 4).alias("delivery"), "metric").distinct()
    folder = scratch(v.spark, "sink")
    sink = K.UniqueSink(f"{folder}/table", ["instance", "day"], ["metric"])
    replayed_through(v, m.withColumn("ord", F.col("delivery").cast("double")), lambda stream: stream.drop("ord"), sink, cuts=[0.0, 1.0, 2.0])
    out = sink.outcomes(v.spark)
    none = v.spark.createDataFrame([], "outcome string, delivery long, n long")
    return none if out is None else out.groupBy("outcome", "delivery").agg(F.count("*").alias("n"))


_JSON = "'{\"event_id\":'||event_id||',\"metric\":\"'||metric||'\",\"service\":\"'||service||'\",\"win\":'||win||'}'"
SQL["v_archived"] = f"SELECT win, metric, sha256({_JSON}) AS d FROM (SELECT event_id, metric, service, CAST(floor(timestamp/86400) AS BIGINT) AS win FROM v_metrics)"
_PIECES = ", ".join(f"sum(('0x'||substr(d, {1 + 15 * i}, 15))::BIGINT) AS h{i}" for i in range(4))


@query("src_20_sealed_archive", f"SELECT win, CAST(sum(n) AS BIGINT) AS n, count(*) AS kinds, sha256(string_agg(line, ';' ORDER BY line)) AS content, NULL::VARCHAR AS issue FROM (SELECT win, n, metric||'|'||n||'|'||h0||'|'||h1||'|'||h2||'|'||h3 AS line FROM (SELECT win, metric, count(*) AS n, {_PIECES} FROM v_archived GROUP BY 1,2)) GROUP BY 1")
def _(v):
    rows = v.metrics().select("event_id", "metric", "service", F.floor(F.col("timestamp") / 86400).alias("win"))
    archive = K.WindowArchive(f"{scratch(v.spark, 'archive')}/a", "win", "metric")
    archive.seal(rows)
    archive.seal(rows)
    issues = archive.verify(v.spark).select(F.col("win").cast("long").alias("win"), "issue")
    return archive.manifest(v.spark).join(issues, "win", "left")


@query("src_14_dataset_manifest")
def _(v):
    found = written(K.file_manifest(v.spark, v.folder, "*.parquet"))
    listed = found.withColumn("role", F.when(F.col("name").startswith("labels"), "label").otherwise("input"))
    issues = K.manifest_issues(listed, found, ["labels.parquet"])
    return found.join(issues.groupBy("name").agg(F.concat_ws(",", F.array_sort(F.collect_list("issue"))).alias("issues")), "name", "left")


#: Weekly topologies as a collector would record them that works with the structure of the week before and holds a snapshot for a day too long; ids come again after three weeks.
SQL["v_wrecorded"] = """SELECT 'w'||(snapshot_id%3) AS snapshot_id, snapshot_id*7 AS valid_from, snapshot_id*7+8 AS valid_to, print, coalesce(lag(print) OVER (ORDER BY snapshot_id), print) AS recorded FROM (SELECT snapshot_id, sha256(string_agg(p, '|' ORDER BY p)) AS print FROM (SELECT snapshot_id, 's:'||service AS p FROM v_wservices UNION SELECT snapshot_id, 'e:'||parent||'>'||target FROM v_wedges) GROUP BY 1)"""


@query("val_07_version_rules", """SELECT snapshot_id, valid_from, 'changed_structure' AS issue FROM v_wrecorded WHERE print<>recorded UNION ALL SELECT snapshot_id, valid_from, 'repeated_id' FROM (SELECT *, count(*) OVER (PARTITION BY snapshot_id) AS n FROM v_wrecorded) WHERE n>1
 UNION ALL SELECT snapshot_id, valid_from, 'overlap' FROM (SELECT *, max(valid_to) OVER (ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_wrecorded) WHERE before>valid_from""")
def _(v):
    from pyspark.sql.window import Window

    _, _, services, edges, _ = learner.inputs(v)
    structure = services.select("snapshot_id", F.concat(F.lit("s:"), "service").alias("part")).unionByName(edges.select("snapshot_id", F.concat(F.lit("e:"), "parent", F.lit(">"), "target").alias("part")))
    prints = V.structure_prints(structure, "snapshot_id", "part")
    week = F.col("snapshot_id")
    numbered = prints.select(F.concat(F.lit("w"), (week % 3).cast("string")).alias("snapshot_id"), (week * 7).alias("valid_from"), (week * 7 + 8).alias("valid_to"), "print", F.coalesce(F.lag("print").over(Window.partitionBy(F.lit(0)).orderBy("snapshot_id")), "print").alias("recorded"))
    return V.version_issues(numbered).select("snapshot_id", "valid_from", "issue")
