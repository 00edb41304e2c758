"""Queries for inventories, archives and further checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators import joint as J
from faultline.operators import validation as V

from .diagnosis import signatures
from .joint import removal
from .views import SQL, query


def objects(v):
    """Customers as pod objects in JSON: their nation is the service, their segment the runtime."""
    nation = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("service"))
    c = v.table("customer").join(nation, "c_nationkey")
    status = lambda kind, seg: F.struct(F.lit(kind).alias("kind"), F.concat(F.lower(seg), F.lit("://"), F.col("c_custkey").cast("string"), F.lit(kind)).alias("id"))
    body = F.to_json(F.struct(F.col("c_name").alias("name"), "service", F.array(status("app", F.col("c_mktsegment")), status("init", F.col("c_mktsegment"))).alias("containers"), (F.col("c_acctbal") > 0).alias("ready")))
    return c.select(F.col("c_custkey").alias("uid"), body.alias("body"))


POD = "name string, service string, containers array<struct<kind:string,id:string>>, ready boolean"


@query("src_16_membership", "SELECT n_name AS service, count(*) AS members, count(*) FILTER (c_acctbal>0) AS ready FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def _(v):
    pods = objects(v).select("uid", F.from_json("body", POD).alias("o")).select("uid", "o.*")
    return pods.groupBy("service").agg(F.count("*").alias("members"), F.count(F.when(F.col("ready"), 1)).alias("ready"))


@query("src_18_runtime_identities", "SELECT lower(c_mktsegment) AS runtime, k AS kind, count(*) AS n, count(DISTINCT c_custkey) AS pods FROM customer CROSS JOIN (VALUES ('app'),('init')) t(k) GROUP BY 1,2")
def _(v):
    pods = objects(v).select("uid", F.from_json("body", POD).alias("o")).select("uid", F.explode("o.containers").alias("c"))
    return pods.groupBy(F.split("c.id", "://")[0].alias("runtime"), F.col("c.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("uid").alias("pods"))


SQL["v_seq"] = "SELECT CAST(floor(timestamp/86400) AS BIGINT) AS seq, count(*) AS n, count(*) FILTER (metric='request.error_rate') AS bursts FROM v_metrics GROUP BY 1"


@query("src_20_archive_manifest", "SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS records, min(seq) AS first, max(seq) AS last, max(seq)-min(seq)+1=count(*) AS contiguous FROM v_seq")
def _(v):
    w = v.metrics().groupBy(F.floor(F.col("timestamp") / 86400).alias("seq")).agg(F.count("*").alias("n"))
    return w.agg(F.count("*").alias("windows"), F.sum("n").alias("records"), F.min("seq").alias("first"), F.max("seq").alias("last"), (F.max("seq") - F.min("seq") + 1 == F.count("*")).alias("contiguous"))


@query("src_21_paired_archives", "SELECT seq, CASE WHEN bursts=0 THEN 'missing' END AS problem FROM v_seq WHERE bursts=0")
def _(v):
    m = v.metrics().withColumn("seq", F.floor(F.col("timestamp") / 86400))
    return V.coverage(m.select("seq"), m.where("metric = 'request.error_rate'").select("seq"), ["seq"])


@query("src_26_window_topology", "SELECT month, count(*) AS edges, count(DISTINCT src) AS sources FROM v_calls c WHERE EXISTS (SELECT 1 FROM v_graph g WHERE g.src=c.src AND g.dst=c.dst) GROUP BY 1")
def _(v):
    known = v.graph().select("src", "dst").distinct()
    return v.calls().join(known, ["src", "dst"], "left_semi").groupBy("month").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


@query("src_28_stats_dump", "SELECT service, avg(value) AS mean, max(value) AS top FROM v_metrics GROUP BY 1")
def _(v):
    table = F.concat_ws("   ", F.concat(F.lit("id"), F.col("instance")), "service", F.col("value").cast("string"))
    cells = F.split(F.col("line"), r"\s+")
    rows = v.metrics().select(table.alias("line")).select(cells[1].alias("service"), cells[2].cast("double").alias("value"))
    return rows.groupBy("service").agg(F.avg("value").alias("mean"), F.max("value").alias("top"))


@query("val_05_burst_targets", "SELECT CASE WHEN k IS NULL THEN 'no_group' WHEN k>1 THEN 'several_groups' ELSE 'ok' END AS problem, count(*) AS n FROM v_metrics m LEFT JOIN (SELECT root_service AS service, count(*) AS k FROM (SELECT root_service FROM v_incidents UNION ALL SELECT 'svc1') GROUP BY 1) g ON g.service=m.service GROUP BY 1")
def _(v):
    groups = v.incidents().select(F.col("root_service").alias("service")).unionByName(v.spark.range(1).select(F.lit("svc1").alias("service"))).groupBy("service").agg(F.count("*").alias("k"))
    j = v.metrics().join(groups, "service", "left")
    return j.groupBy(F.when(F.col("k").isNull(), "no_group").when(F.col("k") > 1, "several_groups").otherwise("ok").alias("problem")).agg(F.count("*").alias("n"))


@query("val_11_window_metadata", "SELECT event_id%10=0 AS broken, count(*) AS n FROM v_metrics GROUP BY 1")
def _(v):
    meta = F.map_from_arrays(F.when(F.col("event_id") % 10 == 0, F.array(F.lit("build"))).otherwise(F.array(F.lit("build"), F.lit("aggregation"))), F.when(F.col("event_id") % 10 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))))
    wrong = F.size(F.array_except(F.array(F.lit("build"), F.lit("aggregation")), F.map_keys(meta))) > 0
    return v.metrics().groupBy(wrong.alias("broken")).agg(F.count("*").alias("n"))


@query("dia_03_combined_counterfactuals")
def _(v):
    """Removal of services and of single metrics, 0.6 to 0.4."""
    s = removal(v).select("incident_id", F.col("candidate").alias("service"), F.col("relative").alias("service_gain"))
    x = signatures(v)
    m = J.removal_gain(x.select("incident_id", F.col("service").alias("row"), F.col("metric").alias("candidate"), (F.col("x") * 0.1).alias("value")), x.groupBy("incident_id", F.col("service").alias("row")).agg(F.avg("x").alias("y")))
    both = s.join(m.select("incident_id", F.col("candidate").alias("metric"), F.col("relative").alias("metric_gain")), "incident_id")
    t = both.withColumn("combined", 0.6 * F.col("service_gain") + 0.4 * F.col("metric_gain"))
    w = Window.partitionBy("incident_id").orderBy(F.desc("combined"), "service", "metric")
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("incident_id", "service", "metric", "combined", "rank")


@query("prp_27_root_residual_rank")
def _(v):
    from faultline.operators.propagation import recursive

    from .propagation import training

    r = recursive(training(v)).groupBy("target").agg(F.avg(F.abs("residual")).alias("residual"))
    ranked = r.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("residual"), "target")))  # one row a node
    i = v.incidents().select("incident_id", F.concat_ws(".", "root_service", "root_metric").alias("target"))
    return i.join(ranked, "target").select("incident_id", "target", "residual", "rank")
