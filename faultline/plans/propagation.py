"""Queries for propagation models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators import propagation as P

from .views import SQL, query

DAY = 86400.0
SQL["v_dpanel"] = "SELECT node_id, service, metric, ts, value, (value-avg(value) OVER (PARTITION BY node_id))/stddev_pop(value) OVER (PARTITION BY node_id) AS z FROM (SELECT service||'.'||metric AS node_id, service, metric, floor(timestamp/86400)*86400 AS ts, avg(value) AS value FROM v_metrics GROUP BY 1,2,3,4)"
SQL["v_calls11"] = "SELECT src, dst FROM v_graph WHERE edge_type='call'"
SQL["v_parents"] = "SELECT t.node_id AS target, p.node_id AS parent, CASE WHEN t.node_id=p.node_id THEN 'self' ELSE 'service' END AS relation FROM (SELECT DISTINCT node_id, service FROM v_dpanel) t JOIN (SELECT DISTINCT node_id, service FROM v_dpanel) p ON t.service=p.service UNION ALL SELECT DISTINCT t.node_id, p.node_id, 'graph' FROM (SELECT DISTINCT node_id, service FROM v_dpanel) t JOIN v_calls11 e ON e.dst=t.service JOIN (SELECT DISTINCT node_id, service FROM v_dpanel) p ON p.service=e.src WHERE e.src<>t.service"
SQL["v_limited"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE relation WHEN 'self' THEN 0 WHEN 'service' THEN 1 ELSE 2 END, parent) AS priority FROM v_parents) WHERE priority<=4"


def panel(v):
    ts = (F.floor(F.col("timestamp") / DAY) * DAY).cast("double")
    p = v.metrics().groupBy("service", "metric", ts.alias("ts")).agg(F.avg("value").alias("value")).withColumn("node_id", F.concat_ws(".", "service", "metric"))
    w = Window.partitionBy("node_id")
    return p.withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))


def nodes(v):
    return panel(v).select("node_id", "service").distinct()


def parents(v):
    return P.allowed_parents(nodes(v), v.graph().where("edge_type = 'call'").select("src", "dst"))


def limited(v):
    return P.limited_parents(parents(v), 4)


def training(v, lags=(1,)):
    return P.complete(P.lagged(panel(v), limited(v), list(lags), DAY))


def fit(v, lags=(1,), lam=1.0):
    return P.ridge(P.gram(training(v, lags)), lam)


@query("prp_01_incident_panel", """WITH t AS (SELECT incident_id, ts, start_ts, coalesce(lag(ts) OVER (PARTITION BY incident_id ORDER BY ts DESC)-ts, 0) AS gap FROM (SELECT DISTINCT ts FROM v_dpanel) JOIN v_incidents ON ts<end_ts), r AS (SELECT *, sum(CASE WHEN gap>129600 THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY ts DESC) AS b FROM t)
 SELECT incident_id, ts>=start_ts AS faulty, count(*) AS n, sum(value) AS total FROM r JOIN v_dpanel USING (ts) WHERE b=0 GROUP BY 1,2""")
def _(v):
    return P.incident_panel(panel(v), v.incidents(), DAY).groupBy("incident_id", "faulty").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("prp_02_masked_panel", "SELECT node_id, ts, avg(value) AS value, bool_or(value>50) AS mask, max(CASE WHEN metric LIKE 'request.%' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) AS probability FROM (SELECT service||'.'||metric AS node_id, metric, floor(timestamp/86400)*86400 AS ts, value FROM v_metrics) GROUP BY 1,2")
def _(v):
    ts = (F.floor(F.col("timestamp") / DAY) * DAY).cast("double")
    rows = v.metrics().select(F.concat_ws(".", "service", "metric").alias("node_id"), ts.alias("ts"), "value", F.when(F.col("metric").startswith("request."), 1.0).otherwise(0.4).alias("p"))
    return rows.groupBy("node_id", "ts").agg(F.avg("value").alias("value"), F.bool_or(F.col("value") > 50).alias("mask"), F.max("p").alias("probability"))


@query("prp_03_allowed_parents", "SELECT * FROM v_parents")
def _(v):
    return parents(v)


@query("prp_04_ridge")
def _(v):
    return fit(v)


@query("prp_05_ipw_ridge")
def _(v):
    rows = training(v).withColumn("w", F.when(F.col("target").contains("request."), 1.0).otherwise(S.ipw_weight(F.lit(0.4))))
    return P.ridge(P.gram(rows.withColumn("pw", F.col("w")), "pw"), 1.0)


@query("prp_06_residuals")
def _(v):
    return P.predict(training(v), fit(v)).select("target", "ts", "y", "predicted", "residual")


@query("prp_07_limited_parents", "SELECT target, parent, relation, priority FROM v_limited")
def _(v):
    return limited(v)


@query("prp_08_recursive_fit")
def _(v):
    return P.recursive(training(v))


@query("prp_09_update_counts")
def _(v):
    return P.recursive(training(v)).groupBy("target").agg(F.max("updates").alias("updates"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))


@query("prp_10_relation_strength")
def _(v):
    c = fit(v, (1, 2)).withColumn("parent", F.split("feature", "@")[0])
    return c.groupBy("target", "parent").agg(F.sqrt(F.sum(F.col("coefficient") * F.col("coefficient"))).alias("strength"))


SQL["v_train"] = "SELECT l.target, y.ts, y.z AS y, l.parent||'@1' AS feature, x.z AS x FROM v_limited l JOIN v_dpanel y ON y.node_id=l.target JOIN v_dpanel x ON x.node_id=l.parent AND x.ts=y.ts-86400"
SQL["v_complete"] = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY target, ts) AS have FROM v_train) JOIN (SELECT target, count(DISTINCT feature) AS need FROM v_train GROUP BY 1) USING (target) WHERE have=need"


@query("prp_11_readiness", "SELECT target, count(DISTINCT ts) AS updates, CASE WHEN count(DISTINCT ts)>=20 THEN 'ready' ELSE 'too_few_updates' END AS status FROM v_complete GROUP BY 1")
def _(v):
    t = training(v).groupBy("target").agg(F.count_distinct("ts").alias("updates"))
    return t.withColumn("status", F.when(F.col("updates") >= 20, "ready").otherwise("too_few_updates"))


@query("prp_12_predictions_with_parts")
def _(v):
    p = P.predict(training(v), fit(v))
    return p.select("target", "ts", F.explode("contributions").alias("c")).select("target", "ts", "c.feature", "c.part")


@query("prp_13_sparse_export")
def _(v):
    return fit(v).where("abs(coefficient) >= 1e-10").select("target", "feature", "coefficient")


@query("prp_14_semantic_mask", "SELECT target, parent FROM v_parents WHERE relation<>'graph' OR (target LIKE '%.request.%' AND parent LIKE '%.request.%')")
def _(v):
    keep = (F.col("relation") != "graph") | (F.col("target").contains(".request.") & F.col("parent").contains(".request."))
    return parents(v).where(keep).select("target", "parent")


@query("prp_15_ridge_readiness")
def _(v):
    f = fit(v, (1,), 0.1)
    return f.groupBy("target").agg(F.max("rows").alias("rows"), F.max("rank").alias("rank"), F.max("condition").alias("condition"), F.count("*").alias("features")).withColumn("ready", (F.col("rows") >= 20) & (F.col("rank") == F.col("features")))


@query("prp_16_rule_features", "SELECT target, parent, relation, lag FROM v_limited CROSS JOIN (SELECT unnest([1,2,3]) AS lag) WHERE relation<>'self' OR lag=1")
def _(v):
    lags = F.when(F.col("relation") == "self", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return limited(v).select("target", "parent", "relation", F.explode(lags).alias("lag"))


@query("prp_17_training_reasons", "SELECT target, reason, count(*) AS n FROM (SELECT l.target, y.ts, CASE WHEN bool_or(x.z IS NULL) THEN 'missing_lag' WHEN max(y.value)>400 THEN 'not_healthy' ELSE 'kept' END AS reason FROM v_limited l JOIN v_dpanel y ON y.node_id=l.target LEFT JOIN v_dpanel x ON x.node_id=l.parent AND x.ts=y.ts-86400 GROUP BY 1,2) GROUP BY 1,2")
def _(v):
    p = panel(v)
    y = limited(v).select("target", "parent").join(p.select(F.col("node_id").alias("target"), "ts", "value"), "target")
    x = p.select(F.col("node_id").alias("parent"), (F.col("ts") + DAY).alias("ts"), F.col("z").alias("x"))
    j = y.join(x, ["parent", "ts"], "left").groupBy("target", "ts").agg(F.bool_or(F.col("x").isNull()).alias("missing"), F.max("value").alias("value"))
    reason = F.when(F.col("missing"), "missing_lag").when(F.col("value") > 400, "not_healthy").otherwise("kept")
    return j.groupBy("target", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("prp_18_metric_ridge")
def _(v):
    return fit(v, (1,), 0.1).select("target", "feature", "coefficient", "rows", F.sha2(F.concat_ws("|", "target", "feature"), 256).alias("model_id"))


@query("prp_19_window_prediction")
def _(v):
    last = training(v).where(F.col("ts") >= 1706400000.0)
    return P.predict(last, fit(v)).select("target", "ts", "predicted", F.size("contributions").alias("parents"))


@query("prp_21_structured_parents", "SELECT target, parent, relation, CASE relation WHEN 'self' THEN 1.0 WHEN 'service' THEN 0.8 ELSE 0.5 END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE relation WHEN 'self' THEN 0 WHEN 'service' THEN 1 ELSE 2 END, parent) AS r FROM v_parents) WHERE r<=6")
def _(v):
    weight = F.when(F.col("relation") == "self", 1.0).when(F.col("relation") == "service", 0.8).otherwise(0.5)
    return P.limited_parents(parents(v), 6).select("target", "parent", "relation", weight.alias("weight"))


@query("prp_22_multilag_ridge")
def _(v):
    rows = training(v, (1, 2, 3))
    p = P.predict(rows, P.ridge(P.gram(rows), 0.1))
    return p.groupBy("target").agg((1 - F.sum(F.col("residual") ** 2) / F.sum(F.col("y") ** 2)).alias("explained"), F.count("*").alias("n"))


@query("prp_24_support_index")
def _(v):
    rows = P.complete(P.lagged(panel(v), P.limited_parents(parents(v), 8), [1], DAY))
    c = P.ridge(P.gram(rows)).withColumn("parent", F.split("feature", "@")[0])
    return P.support_index(c, lambda x: F.split(x, r"\.")[0])


@query("prp_25_topology_share", "SELECT src, dst, count(DISTINCT snapshot_id)/(SELECT count(DISTINCT snapshot_id) FROM v_snapshots) AS share FROM v_snapshots GROUP BY 1,2")
def _(v):
    s = v.snapshots()
    total = s.agg(F.count_distinct("snapshot_id").alias("total"))
    return s.groupBy("src", "dst").agg(F.count_distinct("snapshot_id").alias("n")).join(total).select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


@query("prp_26_cross_prediction")
def _(v):
    c = fit(v).where(F.split("feature", "@")[0] != F.col("target"))
    return P.predict(training(v), c).select("target", "ts", F.col("predicted").alias("cross_predicted"))


@query("prp_28_aligned_panel", "SELECT service, count(*) AS cells, count(z) AS present FROM (SELECT n.service, p.z FROM (SELECT DISTINCT ts FROM v_dpanel) t CROSS JOIN (SELECT DISTINCT node_id, service FROM v_dpanel) n LEFT JOIN v_dpanel p ON p.ts=t.ts AND p.node_id=n.node_id) GROUP BY 1")
def _(v):
    a = P.aligned(panel(v), nodes(v)).withColumn("service", F.split("node_id", r"\.")[0])
    return a.groupBy("service").agg(F.count("*").alias("cells"), F.sum(F.col("mask").cast("long")).alias("present"))
