"""Queries for the joint system, counterfactuals, independence clusters and further streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import inversion as I
from faultline.operators import joint as J
from faultline.operators import topology as T
from faultline.streaming import windows as W

from .diagnosis import ring, signatures
from .evidence import evidence, signal, sparse
from .propagation import panel
from .streams import _with_store, replayed, scratch
from .views import SQL, query

SQL["v_pred"] = "SELECT node_id, ts+86400 AS ts, z*0.5 AS predicted FROM v_dpanel WHERE metric<>'io.write_bytes'"


@query("inv_10_root_residual", "SELECT a.node_id, a.ts, a.z-p.predicted AS residual FROM v_dpanel a JOIN v_pred p ON a.node_id=p.node_id AND a.ts=p.ts")
def _(v):
    return J.aligned_residuals(*_sides(v), ["node_id", "ts"]).where("reason = 'ok'").select("node_id", "ts", "residual")


def _sides(v):
    p = panel(v)
    return p.select("node_id", "ts", F.col("z").alias("actual")), p.where("metric <> 'io.write_bytes'").select("node_id", (F.col("ts") + 86400.0).alias("ts"), (F.col("z") * 0.5).alias("predicted"))


@query("inv_13_aligned_residuals", "SELECT CASE WHEN a.z IS NULL THEN 'missing_actual' WHEN predicted IS NULL THEN 'missing_prediction' ELSE 'ok' END AS reason, count(*) AS n, sum(a.z-predicted) AS total FROM v_dpanel a FULL JOIN v_pred p ON a.node_id=p.node_id AND a.ts=p.ts GROUP BY 1")
def _(v):
    return J.aligned_residuals(*_sides(v), ["node_id", "ts"]).groupBy("reason").agg(F.count("*").alias("n"), F.sum("residual").alias("total"))


SQL["v_dict"] = "SELECT incident_id, service, metric, CASE WHEN n>0 THEN x/n ELSE 0.0 END AS value FROM (SELECT *, sqrt(sum(x*x) OVER (PARTITION BY incident_id, service)) AS n FROM v_sig)"


def dictionary(v):
    return J.normalised_columns(signatures(v).select("incident_id", "service", "metric", F.col("x").alias("value")), ["incident_id", "service"])


@query("inv_14_dictionary", "SELECT * FROM v_dict")
def _(v):
    return dictionary(v)


@query("inv_15_joint_table", "SELECT incident_id, kind, count(*) AS entries, sum(value*value) AS energy FROM (SELECT incident_id, 'node' AS kind, value FROM v_dict UNION ALL SELECT incident_id, 'signal', signal FROM v_signal) GROUP BY 1,2")
def _(v):
    a = dictionary(v).select("incident_id", F.lit("node").alias("kind"), "value")
    b = signal(v).select("incident_id", F.lit("signal").alias("kind"), F.col("signal").alias("value"))
    return a.unionByName(b).groupBy("incident_id", "kind").agg(F.count("*").alias("entries"), F.sum(F.col("value") * F.col("value")).alias("energy"))


@query("inv_16_weights_and_penalties", "SELECT e.incident_id, e.service, e.metric, sigma*sqrt(2*ln(n+1))/(1+2*value) AS penalty FROM (SELECT *, count(*) OVER (PARTITION BY incident_id, evidence_type) AS n FROM v_evidence) e JOIN (SELECT incident_id, 1.4826*median(abs(x)) AS sigma FROM v_sig GROUP BY 1) s USING (incident_id)")
def _(v):
    sigma = signatures(v).groupBy("incident_id").agg((1.4826 * F.percentile(F.abs("x"), 0.5)).alias("sigma"))
    cols = evidence(v).select("incident_id", "service", "metric", F.col("evidence_type").alias("block"), F.col("value").alias("evidence"))
    return J.block_penalties(cols, sigma).select("incident_id", "service", "metric", "penalty")


@query("inv_17_group_partitions", "SELECT incident_id, service, metric, dense_rank() OVER (PARTITION BY incident_id ORDER BY service)-1 AS group_no FROM v_sparse")
def _(v):
    return J.numbered(sparse(v), ["service"], "incident_id").select("incident_id", "service", "metric", "group_no")


@query("inv_18_problem_table", "SELECT d.incident_id, d.metric AS \"row\", greatest(0.05, min(coalesce(signal,0)/10)) AS weight FROM v_dict d LEFT JOIN v_signal s ON s.incident_id=d.incident_id AND s.service=d.service AND s.metric=d.metric GROUP BY 1,2")
def _(v):
    j = dictionary(v).join(signal(v).select("incident_id", "service", "metric", "signal"), ["incident_id", "service", "metric"], "left")
    return J.quality_weights(j.select("incident_id", F.col("metric").alias("row"), (F.coalesce("signal", F.lit(0.0)) / 10).alias("quality")), 0.05)


def problems(v):
    """One row an incident: services as columns, metrics as rows of a small matrix."""
    d = dictionary(v).groupBy("incident_id", "metric").agg(F.transform(F.sort_array(F.collect_list(F.struct("service", "value"))), lambda x: x["value"]).alias("a"))
    y = signatures(v).groupBy("incident_id", "metric").agg(F.avg("x").alias("y"))
    t = d.join(y, ["incident_id", "metric"]).groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("metric", "a", "y"))).alias("m"))
    n = F.size(F.col("m")[0]["a"])
    return t.select(
        "incident_id", F.flatten(F.transform("m", lambda x: x["a"])).alias("a"), F.transform("m", lambda x: x["y"]).alias("r"), F.transform("m", lambda x: F.lit(1.0)).alias("w"),
        F.array_repeat(F.lit(0.02), n).alias("l1"), F.sequence(F.lit(0), n - 1).alias("blocks"), F.lit(0.02).alias("group"),
    )


@query("inv_19_weighted_solve")
def _(v):
    return problems(v).mapInPandas(I.fista, "incident_id string, x array<double>, objective double, iterations int, converged boolean")


SQL["v_contrib"] = "SELECT incident_id, metric AS \"row\", service AS candidate, value*0.1 AS value FROM v_dict"
_REMOVE = """SELECT incident_id, candidate, delta, delta/(base+1e-9) AS relative, row_number() OVER (PARTITION BY incident_id ORDER BY delta DESC, candidate) AS rank FROM (SELECT c.incident_id, c.candidate, sum(pow(y-fit+value,2)-pow(y-fit,2)) AS delta FROM v_contrib c JOIN (SELECT incident_id, "row", sum(value) AS fit FROM v_contrib GROUP BY 1,2) f ON f.incident_id=c.incident_id AND f."row"=c."row" JOIN (SELECT incident_id, metric AS "row", avg(x) AS y FROM v_sig GROUP BY 1,2) r ON r.incident_id=c.incident_id AND r."row"=c."row" GROUP BY 1,2)
 JOIN (SELECT f.incident_id, sum(pow(y-fit,2)) AS base FROM (SELECT incident_id, "row", sum(value) AS fit FROM v_contrib GROUP BY 1,2) f JOIN (SELECT incident_id, metric AS "row", avg(x) AS y FROM v_sig GROUP BY 1,2) r ON r.incident_id=f.incident_id AND r."row"=f."row" GROUP BY 1) USING (incident_id)"""


def removal(v):
    c = dictionary(v).select("incident_id", F.col("metric").alias("row"), F.col("service").alias("candidate"), (F.col("value") * 0.1).alias("value"))
    y = signatures(v).groupBy("incident_id", F.col("metric").alias("row")).agg(F.avg("x").alias("y"))
    return J.removal_gain(c, y)


@query("dia_02_counterfactuals", _REMOVE)
def _(v):
    return removal(v).select("incident_id", "candidate", "delta", "relative", "rank")


@query("dia_04_root_counterfactual_rank", f"SELECT i.incident_id, rank AS root_rank FROM v_incidents i JOIN ({_REMOVE}) c ON c.incident_id=i.incident_id AND c.candidate=root_service")
def _(v):
    i = v.incidents().select("incident_id", F.col("root_service").alias("candidate"))
    return i.join(removal(v), ["incident_id", "candidate"]).select("incident_id", F.col("rank").alias("root_rank"))


@query("evd_20_independence", "WITH RECURSIVE e AS (SELECT DISTINCT service AS target, event_id AS item, 'n'||(event_id%7) AS channel, 'u'||(event_id%90) AS source, least(value/500,1) AS strength FROM v_metrics WHERE value>300), l AS (SELECT target, item, item AS cluster FROM e UNION SELECT b.target, b.item, l.cluster FROM l JOIN e a ON a.target=l.target AND a.item=l.item JOIN e b ON b.target=a.target AND (b.channel=a.channel OR b.source=a.source) WHERE l.cluster<b.item), c AS (SELECT target, item, min(cluster) AS cluster FROM l GROUP BY 1,2) SELECT target, 1-product(1-s) AS strength, count(*) AS clusters FROM (SELECT e.target, cluster, max(strength) AS s FROM e JOIN c ON c.target=e.target AND c.item=e.item GROUP BY 1,2) GROUP BY 1")
def _(v):
    if not v.spark.sparkContext.getCheckpointDir():
        v.spark.sparkContext.setCheckpointDir(scratch(v.spark))
    tag = lambda p, n: F.concat(F.lit(p), (F.col("event_id") % n).cast("string"))
    e = v.metrics().where("value > 300").select(F.col("service").alias("target"), F.col("event_id").alias("item"), tag("n", 7).alias("channel"), tag("u", 90).alias("source"), F.least(F.col("value") / 500, F.lit(1.0)).alias("strength"))
    return J.independent_strength(e, J.independence_clusters(e))


@query("prp_23_path_support", "WITH RECURSIVE w AS (SELECT src AS s, src AS n, 0 AS h, 1.0::DOUBLE AS score FROM v_adj UNION ALL SELECT s, dst, h+1, score*weight*0.8 FROM w JOIN v_adj ON src=n WHERE h<10) SELECT s AS service, max(score) AS support FROM w WHERE n='svc0' AND s<>'svc0' GROUP BY 1")
def _(v):
    p = T.simple_paths(ring(v).select(F.col("src").alias("seed")).distinct(), ring(v).withColumn("weight", F.col("weight") * 0.8), 10)
    return p.where("node = 'svc0'").groupBy(F.col("seed").alias("service")).agg(F.max("score").alias("support"))


@query("src_07_log_lines", "SELECT service, metric AS phase, sum(value) AS wait, max(value) AS top, count(*) AS n FROM v_metrics WHERE event_id%50<>0 GROUP BY 1,2")
def _(v):
    good = F.to_json(F.struct("service", F.col("metric").alias("phase"), F.col("value").alias("wait")))
    lines = v.metrics().select(F.when(F.col("event_id") % 50 == 0, F.lit("not json")).otherwise(good).alias("line"))
    rows = lines.select(F.from_json("line", "service string, phase string, wait double").alias("r")).select("r.*").where("service is not null")
    return rows.groupBy("service", "phase").agg(F.sum("wait").alias("wait"), F.max("wait").alias("top"), F.count("*").alias("n"))


@query("src_06_counter_dumps", "SELECT service, sum(CAST(floor(value) AS BIGINT)) AS retrans, avg(value/10) AS mean_rtt FROM v_metrics GROUP BY 1")
def _(v):
    dump = F.concat(F.lit("Tcp: InSegs RetransSegs\nTcp: 1 "), F.floor("value").cast("string"), F.lit("\nrtt:"), (F.col("value") / 10).cast("string"), F.lit("/2"))
    lines = F.split(F.col("dump"), "\n")
    table = F.map_from_arrays(F.slice(F.split(lines[0], " "), 2, 2), F.slice(F.split(lines[1], " "), 2, 2))
    rows = v.metrics().select("service", dump.alias("dump")).select("service", table["RetransSegs"].cast("long").alias("retrans"), F.regexp_extract("dump", r"rtt:([0-9.E-]+)", 1).cast("double").alias("rtt"))
    return rows.groupBy("service").agg(F.sum("retrans").alias("retrans"), F.avg("rtt").alias("mean_rtt"))


@query("str_02_late_rows", "SELECT service, count(*) AS n, 0 AS late FROM v_metrics GROUP BY 1")
def _(v):
    _with_store(v)
    rows = v.metrics().select(F.col("service").alias("key"), F.floor(F.col("timestamp") / 86400).alias("win"), "value", F.col("timestamp").alias("ord"))
    out = replayed(v, rows, lambda stream: W.stateful(stream.drop("ord"), "key", W.LateSplit(0)))
    return out.groupBy(F.col("key").alias("service")).agg(F.count("*").alias("n"), F.sum(F.col("late").cast("int")).alias("late"))


@query("str_07_stateful_fit")
def _(v):
    _with_store(v)
    p = panel(v)
    x = p.select("node_id", (F.col("ts") + 86400.0).alias("ts"), F.array(F.lit(1.0), F.col("z")).alias("x"))
    rows = p.join(x, ["node_id", "ts"]).select(F.col("node_id").alias("target"), "ts", F.col("z").alias("y"), "x", F.col("ts").alias("ord"))
    return replayed(v, rows, lambda stream: W.stateful(stream.drop("ord"), "target", W.RecursiveFit()))
