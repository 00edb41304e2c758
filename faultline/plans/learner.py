"""Queries for the propagation models that follow the topology."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators import learner as L
from faultline.operators.tables import written

from .views import SQL, query

DAY, WEEK = 86400.0, 7
LAGS, LEAST_QUALITY, MAX_GAP = [1, 2], 0.6, 2
RULE = {"forgetting": 0.98, "start": 100.0, "least_updates": 5, "least_since": 2}

#: A day's state of a service; services of a week are those with at least the mean count of events; a parent is one of the two services whose events come most often just before the target's on its node.
SQL["v_wstates"] = "SELECT service, CAST(floor(timestamp/86400) AS BIGINT) AS win, avg(value)/100 AS value, count(*)>=2 AS ready, 1-1.0::DOUBLE/(1+count(*)) AS quality FROM v_metrics GROUP BY 1,2"
SQL["v_wsnap"] = "SELECT DISTINCT win, win//7 AS snapshot_id FROM v_wstates"
SQL["v_wservices"] = "SELECT snapshot_id, service FROM (SELECT *, avg(n) OVER (PARTITION BY snapshot_id) AS mean FROM (SELECT CAST(floor(timestamp/86400) AS BIGINT)//7 AS snapshot_id, service, count(*) AS n FROM v_metrics GROUP BY 1,2)) WHERE n>=mean"
SQL["v_wedges"] = """SELECT snapshot_id, parent, target FROM (SELECT p.*, row_number() OVER (PARTITION BY p.snapshot_id, p.target ORDER BY p.n DESC, p.parent) AS r FROM (
 SELECT CAST(floor(timestamp/86400) AS BIGINT)//7 AS snapshot_id, before AS parent, q.service AS target, count(*) AS n FROM (SELECT *, lag(service) OVER (PARTITION BY node ORDER BY timestamp, event_id) AS before FROM v_metrics) q WHERE before<>service GROUP BY 1,2,3) p
 JOIN v_wservices a ON a.snapshot_id=p.snapshot_id AND a.service=p.parent JOIN v_wservices b ON b.snapshot_id=p.snapshot_id AND b.service=p.target) WHERE r<=2"""
SQL["v_wgates"] = "SELECT win, n <= mean + sd AS learns FROM (SELECT *, avg(n) OVER () AS mean, stddev_pop(n) OVER () AS sd FROM (SELECT CAST(floor(timestamp/86400) AS BIGINT) AS win, count(*) FILTER (metric='request.error_rate') AS n FROM v_metrics GROUP BY 1))"
SQL["v_wversions"] = """SELECT win, w.snapshot_id, CAST(version AS INT) AS version FROM v_wsnap w JOIN (SELECT snapshot_id, sum(c) OVER (ORDER BY snapshot_id) AS version FROM (SELECT snapshot_id, CASE WHEN lag(print) OVER (ORDER BY snapshot_id)<>print THEN 1 ELSE 0 END AS c FROM (
 SELECT snapshot_id, list_sort(list(DISTINCT p)) AS print FROM (SELECT snapshot_id, 's '||service AS p FROM v_wservices UNION ALL SELECT snapshot_id, 'e '||parent||' '||target FROM v_wedges) GROUP BY 1))) n ON n.snapshot_id=w.snapshot_id"""
SQL["v_wbreaks"] = "SELECT win FROM (SELECT win, lag(win) OVER (ORDER BY win) AS before FROM v_wsnap) WHERE win-before>2"
SQL["v_wfeatures"] = """WITH par AS (SELECT snapshot_id, service AS target, service AS parent FROM v_wservices UNION SELECT snapshot_id, target, parent FROM v_wedges),
 g AS (SELECT win, version, target, parent, lag FROM v_wversions JOIN par USING (snapshot_id) CROSS JOIN (SELECT unnest([1,2]) AS lag)),
 f AS (SELECT g.*, s.value AS x, CASE WHEN k.win IS NULL OR EXISTS (SELECT 1 FROM v_wbreaks b WHERE b.win>g.win-lag AND b.win<=g.win) THEN 'insufficient_history' WHEN s.value IS NULL THEN 'missing_parent_state' WHEN NOT s.ready THEN 'baseline_not_ready' WHEN s.quality<0.6 THEN 'low_observation_quality' END AS why
  FROM g LEFT JOIN v_wsnap k ON k.win=g.win-lag LEFT JOIN v_wstates s ON s.service=g.parent AND s.win=g.win-lag),
 w AS (SELECT target, win, version, list(parent||'@'||lag ORDER BY parent, lag) AS keys, list(x ORDER BY parent, lag) AS xs, list_filter(list(why ORDER BY parent, lag), lambda r: r IS NOT NULL)[1] AS why FROM f GROUP BY 1,2,3)
 SELECT w.target, w.win, version, keys, CASE WHEN why IS NULL THEN xs END AS x, CASE WHEN s.value IS NULL THEN 'missing_target' ELSE why END AS reason, s.value AS y, coalesce(e.learns, false) AND coalesce(s.ready, false) AND coalesce(s.quality, 0)>=0.6 AS learns,
  CASE WHEN NOT coalesce(e.learns, false) THEN 'update_gate_closed' WHEN NOT s.ready THEN 'baseline_not_ready' WHEN s.quality<0.6 THEN 'low_observation_quality' END AS gate_reason FROM w LEFT JOIN v_wstates s ON s.service=w.target AND s.win=w.win LEFT JOIN v_wgates e ON e.win=w.win"""
#: The recursion over windows, with the carried coefficients t and covariance p before each update.
SQL["v_wmodel"] = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY win) AS k FROM v_wfeatures),
 m AS (SELECT DISTINCT target, 0::BIGINT AS k, 0::BIGINT AS win, -2 AS version, []::VARCHAR[] AS keys, []::DOUBLE[] AS x, []::DOUBLE[] AS before, []::DOUBLE[] AS t, []::DOUBLE[][] AS p, 0 AS updates, 0 AS since, NULL::DOUBLE AS y, NULL::VARCHAR AS reason, NULL::VARCHAR AS gate_reason, false AS learns FROM o
  UNION ALL SELECT target, k, win, version, keys, x, t0,
   CASE WHEN go THEN list_transform(range(1, len(keys)+1), lambda i: t0[i] + px[i]/sc*(y-list_sum(list_transform(range(1, len(x)+1), lambda d: t0[d]*x[d])))) ELSE t0 END,
   CASE WHEN go THEN list_transform(range(1, len(keys)+1), lambda i: list_transform(range(1, len(keys)+1), lambda j: (p0[i][j] - px[i]*px[j]/sc)/0.98)) ELSE p0 END,
   u0 + CASE WHEN go THEN 1 ELSE 0 END, s0 + CASE WHEN go THEN 1 ELSE 0 END, y, reason, gate_reason, learns
  FROM (SELECT *, 0.98 + list_sum(list_transform(range(1, len(px)+1), lambda d: x[d]*px[d])) AS sc FROM (SELECT *, reason IS NULL AND learns AS go, CASE WHEN reason IS NULL THEN list_transform(p0, lambda r: list_sum(list_transform(range(1, len(x)+1), lambda d: r[d]*x[d]))) END AS px FROM (
   SELECT o.target, o.k, o.win, o.version, o.keys, o.x, o.y, o.reason, o.gate_reason, o.learns,
    CASE WHEN o.version=m.version THEN m.t ELSE list_transform(o.keys, lambda q: CASE WHEN o.version=m.version+1 AND list_contains(m.keys, q) THEN m.t[list_position(m.keys, q)] ELSE 0.0::DOUBLE END) END AS t0,
    CASE WHEN o.version=m.version THEN m.p ELSE list_transform(o.keys, lambda a: list_transform(o.keys, lambda b: CASE WHEN o.version=m.version+1 AND list_contains(m.keys, a) AND list_contains(m.keys, b) THEN m.p[list_position(m.keys, a)][list_position(m.keys, b)] WHEN a=b THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)) END AS p0,
    CASE WHEN o.version IN (m.version, m.version+1) THEN m.updates ELSE 0 END AS u0, CASE WHEN o.version=m.version THEN m.since ELSE 0 END AS s0
   FROM m JOIN o ON o.target=m.target AND o.k=m.k+1)))) SELECT * FROM m WHERE k>0"""


def inputs(v):
    """(states, versions, services, edges, gates) as in the SQL above."""
    m = v.metrics().withColumn("win", F.floor(F.col("timestamp") / DAY)).withColumn("snapshot_id", F.floor(F.col("win") / WEEK))
    n = F.count("*")
    states = m.groupBy("service", "win").agg((F.avg("value") / 100).alias("value"), (n >= 2).alias("ready"), (1 - 1 / (1 + n)).alias("quality"))
    counts = m.groupBy("snapshot_id", "service").agg(n.alias("n")).withColumn("mean", F.avg("n").over(Window.partitionBy("snapshot_id")))
    services = counts.where("n >= mean").select("snapshot_id", "service")
    before = F.lag("service").over(Window.partitionBy("node").orderBy("timestamp", "event_id"))
    calls = m.withColumn("parent", before).where("parent <> service").groupBy("snapshot_id", "parent", F.col("service").alias("target")).agg(n.alias("n"))
    both = calls.join(services.withColumnRenamed("service", "parent"), ["snapshot_id", "parent"]).join(services.withColumnRenamed("service", "target"), ["snapshot_id", "target"])
    rank = F.row_number().over(Window.partitionBy("snapshot_id", "target").orderBy(F.desc("n"), "parent"))
    edges = both.withColumn("r", rank).where("r <= 2").select("snapshot_id", "parent", "target")
    errors = m.groupBy("win").agg(F.count_if(F.col("metric") == "request.error_rate").alias("n"))
    usual = errors.agg((F.avg("n") + F.stddev_pop("n")).alias("most"))
    gates = errors.join(F.broadcast(usual)).select("win", (F.col("n") <= F.col("most")).alias("learns"))
    states, services, edges = written(states), written(services), written(edges)
    versions = L.topology_versions(states.select("win", F.floor(F.col("win") / WEEK).alias("snapshot_id")).distinct(), services, edges)
    return states, written(versions), services, edges, gates


def features(v):
    states, versions, services, edges, gates = inputs(v)
    return L.feature_rows(states, versions, services, edges, gates, LAGS, LEAST_QUALITY, MAX_GAP)


@query("prp_12_topology_learner", """SELECT target, win, version, keys[i] AS feature, before[i] AS coefficient, before[i]*x[i] AS part, list_sum(list_transform(range(1, len(x)+1), lambda d: before[d]*x[d])) AS predicted, y-list_sum(list_transform(range(1, len(x)+1), lambda d: before[d]*x[d])) AS residual, updates>=5 AND since>=2 AS ready, learns AS updated, gate_reason AS reason
 FROM (SELECT *, unnest(range(1, len(keys)+1)) AS i FROM v_wmodel WHERE reason IS NULL)""")
def _(v):
    out = L.learn(features(v), **RULE).where("predicted is not null").select("*", F.inline("contributions"))
    return out.select("target", "win", "version", "feature", "coefficient", "part", "predicted", "residual", "ready", "updated", "reason")


@query("prp_12_window_issues", """SELECT win, '*' AS target, 'history_gap' AS issue, '' AS detail FROM v_wbreaks UNION ALL SELECT min(win), '*', CASE WHEN version=0 THEN 'topology_configured' ELSE 'topology_reconfigured' END, CAST(arg_min(snapshot_id, win) AS VARCHAR) FROM v_wversions GROUP BY version
 UNION ALL SELECT n.win, m.service, 'service_archived', CAST(n.snapshot_id AS VARCHAR) FROM (SELECT DISTINCT version, service FROM v_wversions JOIN v_wservices USING (snapshot_id)) m JOIN (SELECT version, min(win) AS win, arg_min(snapshot_id, win) AS snapshot_id FROM v_wversions GROUP BY 1) n ON n.version=m.version+1
  WHERE NOT EXISTS (SELECT 1 FROM v_wversions a JOIN v_wservices b USING (snapshot_id) WHERE a.version=n.version AND b.service=m.service)
 UNION ALL SELECT win, target, reason, '' FROM v_wfeatures WHERE reason IS NOT NULL""")
def _(v):
    states, versions, services, edges, gates = inputs(v)
    f = written(L.feature_rows(states, versions, services, edges, gates, LAGS, LEAST_QUALITY, MAX_GAP))
    return L.window_issues(f, versions, services, MAX_GAP)
