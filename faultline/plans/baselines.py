"""Queries for baselines and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import baselines as B

from .views import DAY0, SQL, query

_STATS = """g AS (SELECT DISTINCT i.incident_id AS incident, start_ts, service, instance, metric FROM v_metrics CROSS JOIN (SELECT incident_id, start_ts FROM v_incidents) i),
 f AS (SELECT g.incident, g.service, g.instance, g.metric, median(value) AS med, count(*) AS n FROM g JOIN v_metrics m ON m.service=g.service AND m.instance=g.instance AND m.metric=g.metric AND timestamp<start_ts GROUP BY 1,2,3,4),
 fm AS (SELECT f.incident, f.service, f.instance, f.metric, med, n, median(abs(value-med)) AS mad FROM f JOIN g USING (incident, service, instance, metric) JOIN v_metrics m ON m.service=f.service AND m.instance=f.instance AND m.metric=f.metric AND timestamp<start_ts GROUP BY 1,2,3,4,5,6),
 c AS (SELECT i.incident_id AS incident, start_ts, service, metric, median(value) AS med, count(*) AS n FROM v_metrics JOIN v_incidents i ON timestamp<start_ts GROUP BY 1,2,3,4),
 cm AS (SELECT incident, c.service, c.metric, med, n, median(abs(value-med)) AS mad FROM c JOIN v_metrics m ON m.service=c.service AND m.metric=c.metric AND timestamp<start_ts GROUP BY 1,2,3,4,5),
 st AS (SELECT g.incident, g.service, g.instance, g.metric, coalesce(fm.med, cm.med) AS median, coalesce(fm.mad, cm.mad) AS mad, 1.4826*coalesce(fm.mad, cm.mad)+1e-6 AS scale, coalesce(fm.n, cm.n) AS baseline_count
  FROM g LEFT JOIN fm USING (incident, service, instance, metric) LEFT JOIN cm ON cm.incident=g.incident AND cm.service=g.service AND cm.metric=g.metric WHERE coalesce(fm.med, cm.med) IS NOT NULL)"""
_RANGES = "rg AS (SELECT incident_id AS incident, coalesce(lag(end_ts) OVER (ORDER BY start_ts), (SELECT min(timestamp) FROM v_metrics)) AS from_ts, end_ts FROM v_incidents)"


@query("bas_01_robust_stats", f"WITH {_STATS} SELECT incident, service, instance, metric, median, mad, baseline_count FROM st")
def _(v):
    return B.robust_stats(v.metrics(), v.incidents()).drop("scale")


@query("bas_02_incident_ranges", f"WITH {_RANGES} SELECT incident, count(*) AS n, min(timestamp) AS first_ts FROM v_metrics JOIN rg ON timestamp>=from_ts AND timestamp<end_ts GROUP BY 1")
def _(v):
    first = v.metrics().agg(F.min("timestamp").alias("first_ts"))
    r = B.incident_ranges(v.incidents().join(first), F.col("first_ts")).select(F.col("incident_id").alias("incident"), "from_ts", "end_ts")
    inside = v.metrics().join(r, (F.col("timestamp") >= F.col("from_ts")) & (F.col("timestamp") < F.col("end_ts")))
    return inside.groupBy("incident").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"))


@query("bas_03_normalise", f"""WITH {_STATS}, {_RANGES} SELECT event_id, rg.incident, greatest(-20.0, least(20.0, (value-median)/scale)) AS z_value
 FROM v_metrics m JOIN rg ON timestamp>=from_ts AND timestamp<end_ts JOIN st ON st.incident=rg.incident AND st.service=m.service AND st.instance=m.instance AND st.metric=m.metric""")
def _(v):
    return B.normalise(v.metrics(), v.incidents()).select("event_id", "incident", "z_value")


SQL["v_z"] = """SELECT m.event_id, m.timestamp, m.service, m.metric, m.value, (m.value-s.med)/(1.4826*s.mad+1e-9) AS z_score FROM v_metrics m JOIN (
 SELECT b.service, b.metric, med, median(abs(value-med)) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY service, metric) AS med FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY timestamp, event_id) AS r, count(*) OVER (PARTITION BY service, metric) AS cnt FROM v_metrics) WHERE cnt>=3 AND r<=greatest(3, ceil(cnt*0.3)))) b GROUP BY 1,2,3) s
 ON s.service=m.service AND s.metric=m.metric"""


def scored(v):
    return B.prefix_z(v.metrics(), ["service", "metric"], ["timestamp", "event_id"])


@query("bas_04_prefix_z", "SELECT event_id, z_score FROM v_z")
def _(v):
    return scored(v).select("event_id", "z_score")


@query("bas_05_before_alert_z", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY node_id) AS cnt, sum(CASE WHEN ts<1704412800 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id) AS early FROM v_panel),
 k AS (SELECT *, CASE WHEN early>=3 THEN 'before_alert' WHEN cnt>=3 THEN 'prefix' ELSE 'all' END AS baseline FROM r),
 b AS (SELECT *, median(value) OVER (PARTITION BY node_id) AS med FROM k WHERE CASE baseline WHEN 'before_alert' THEN ts<1704412800 WHEN 'prefix' THEN r<=greatest(1, ceil(cnt*0.3)) ELSE true END),
 s AS (SELECT node_id, med, median(abs(value-med)) AS mad FROM b GROUP BY 1,2) SELECT node_id, ts, baseline, (value-med)/greatest(1.4826*mad, 1e-6) AS z FROM k JOIN s USING (node_id)""")
def _(v):
    return B.before_alert_z(v.panel(), 1704412800.0, ["node_id"]).select("node_id", "ts", "baseline", "z")


_HELD = """SELECT event_id, series_id, timestamp, value, list_reverse(list_filter(list(CASE WHEN value<300 THEN value END) OVER (PARTITION BY series_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL))[1:5] AS held FROM (SELECT *, instance||'/'||metric AS series_id FROM v_metrics)"""


def _frame(v):
    m = v.metrics().withColumn("series_id", F.concat_ws("/", "instance", "metric"))
    return B.healthy_frame(m, ["series_id"], ["timestamp", "event_id"], 5, F.col("value") < 300)


@query("bas_06_healthy_buffer", f"WITH h AS ({_HELD}) SELECT event_id, coalesce(len(held),0) AS n_held, list_aggregate(held,'median') AS median FROM h")
def _(v):
    return _frame(v).select("event_id", "n_held", "median")


@query("bas_07_rolling_score", f"""WITH h AS ({_HELD}), g AS (SELECT *, coalesce(len(held),0) AS n, list_aggregate(held,'median') AS med FROM h), k AS (SELECT *, list_aggregate(list_transform(held, lambda x: abs(x-med)),'median') AS mad FROM g)
 SELECT event_id, n>=3 AS ready, CASE WHEN n>=3 THEN least(greatest((value-med)/greatest(1.4826*mad, 1.0), 0.0), 8.0) END AS score, CASE WHEN n<3 THEN 'baseline_not_ready' END AS issue FROM k""")
def _(v):
    return B.rolling_score(_frame(v), 3, 1.0, 8.0).select("event_id", "ready", "score", "issue")


def _roles(v):
    rows = [("error", "request.error_rate", "failure"), ("latency", "request.p99_latency_ms", "latency"), ("cpu", "cpu.throttled_usec", "cpu"), ("cpu2", "cpu.throttled_usec", "cpu_b"), ("net", "net.retrans", "network")]
    return v.spark.createDataFrame(rows, "role string, metric string, x string").select("role", "metric")


@query("bas_08_resolve_signals", """WITH ro AS (SELECT * FROM (VALUES ('error','request.error_rate'),('latency','request.p99_latency_ms'),('cpu','cpu.throttled_usec'),('cpu2','cpu.throttled_usec'),('net','net.retrans')) t(role, metric))
 SELECT metric, CASE WHEN k=1 THEN role END AS role, CASE WHEN k IS NULL THEN 'no_role' WHEN k>1 THEN 'several_roles' END AS issue, count(*) AS n FROM v_metrics LEFT JOIN (SELECT metric, count(*) AS k, min(role) AS role FROM ro GROUP BY 1) USING (metric) GROUP BY 1,2,3""")
def _(v):
    return B.resolve_roles(v.metrics(), _roles(v), ["metric"]).groupBy("metric", "role", "issue").agg(F.count("*").alias("n"))


_SCALE = """c AS (SELECT service, metric, count(*) AS n, median(value) AS med, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM v_metrics GROUP BY 1,2),
 s AS (SELECT service, metric, n, med, q1, q3, 1.4826*median(abs(value-med)) AS mad FROM v_metrics JOIN c USING (service, metric) GROUP BY 1,2,3,4,5,6)"""


@query("bas_09_scale_choice", f"WITH {_SCALE} SELECT service, metric, n, CASE WHEN mad>=30 THEN mad WHEN (q3-q1)/1.349>=30 THEN (q3-q1)/1.349 ELSE 30.0 END AS scale, CASE WHEN mad>=30 THEN 'mad' WHEN (q3-q1)/1.349>=30 THEN 'iqr' ELSE 'floor' END AS scale_source FROM s")
def _(v):
    return B.scale_choice(v.metrics(), ["service", "metric"], 30.0).drop("median")


@query("bas_10_readiness", f"WITH {_SCALE} SELECT service, metric, n, n>=150 AS ready, CASE WHEN n<150 THEN 'too_few_samples' WHEN mad<30 AND (q3-q1)/1.349<30 THEN 'scale_at_floor' ELSE 'ready' END AS reason FROM s")
def _(v):
    return B.readiness(v.metrics(), ["service", "metric"], 150, 30.0)


@query("bas_11_valid_windows", """WITH w AS (SELECT service, floor(timestamp/21600)*21600 AS win, count(*) FILTER (metric LIKE 'request.%') AS requests, avg(value) FILTER (metric='request.p99_latency_ms') AS latency, avg(value) FILTER (metric='request.error_rate') AS failure FROM v_metrics GROUP BY 1,2)
 SELECT service, win, requests, latency, failure, CASE WHEN requests=0 THEN 'no_coverage' WHEN latency IS NULL THEN 'missing_latency' WHEN requests<3 THEN 'too_few_requests' ELSE 'valid' END AS validity FROM w""")
def _(v):
    win = (F.floor(F.col("timestamp") / 21600) * 21600).cast("double").alias("win")
    only = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    w = v.metrics().groupBy("service", win).agg(F.count(F.when(F.col("metric").startswith("request."), 1)).alias("requests"), only("request.p99_latency_ms").alias("latency"), only("request.error_rate").alias("failure"))
    return w.withColumn("validity", F.when(F.col("requests") == 0, "no_coverage").when(F.col("latency").isNull(), "missing_latency").when(F.col("requests") < 3, "too_few_requests").otherwise("valid"))


@query("bas_12_resolve_metric", "SELECT service AS entity, metric, CASE WHEN metric='request.error_rate' THEN 'failure' WHEN metric='request.p99_latency_ms' THEN 'latency' ELSE 'resource' END AS role, metric NOT LIKE 'request.%' AS root_eligible, count(*) AS n FROM v_metrics GROUP BY 1,2,3,4")
def _(v):
    role = F.when(F.col("metric") == "request.error_rate", "failure").when(F.col("metric") == "request.p99_latency_ms", "latency").otherwise("resource")
    return v.metrics().groupBy(F.col("service").alias("entity"), "metric", role.alias("role"), (~F.col("metric").startswith("request.")).alias("root_eligible")).agg(F.count("*").alias("n"))


@query("bas_13_service_state", """WITH b AS (SELECT service, floor(timestamp/86400) AS day, CASE WHEN metric LIKE 'request.%' THEN 'load' WHEN metric LIKE 'cpu.%' THEN 'CPU' WHEN metric LIKE 'net.%' THEN 'network' ELSE 'storage I/O' END AS family, max(greatest(z_score,0)) AS score FROM v_z GROUP BY 1,2,3)
 SELECT service, CAST(day AS BIGINT) AS day, sum(score*CASE family WHEN 'load' THEN 0.4 WHEN 'CPU' THEN 0.3 WHEN 'network' THEN 0.2 ELSE 0.1 END) AS service_score, count(*) AS families FROM b GROUP BY 1,2""")
def _(v):
    z = scored(v).select("service", F.floor(F.col("timestamp") / 86400).alias("day"), S.metric_family(F.col("metric")).alias("family"), F.greatest("z_score", F.lit(0.0)).alias("score"))
    return B.family_scores(z, ["service", "day"], {"load": 0.4, "CPU": 0.3, "network": 0.2, "storage I/O": 0.1})


@query("bas_14_symptom_scores", """WITH w AS (SELECT service, CAST(floor(timestamp/3600) AS BIGINT) AS hour, max(greatest(z_score,0)) FILTER (metric='request.p99_latency_ms') AS latency, max(greatest(z_score,0)) FILTER (metric='request.error_rate') AS failure FROM v_z GROUP BY 1,2)
 SELECT service, hour, 0.5*coalesce(latency,0)+0.5*coalesce(failure,0) AS symptom_score FROM w WHERE latency IS NOT NULL OR failure IS NOT NULL""")
def _(v):
    only = lambda m: F.max(F.when(F.col("metric") == m, F.greatest("z_score", F.lit(0.0))))
    w = scored(v).groupBy("service", F.floor(F.col("timestamp") / 3600).alias("hour")).agg(only("request.p99_latency_ms").alias("latency"), only("request.error_rate").alias("failure"))
    return B.symptom_scores(w).select("service", "hour", "symptom_score")


@query("bas_15_state_rows", "SELECT service, CAST(floor(timestamp/86400) AS BIGINT) AS day, max(z_score) AS score, min(1-abs(z_score)/100) AS quality, count(*) AS n FROM v_z GROUP BY 1,2")
def _(v):
    return scored(v).groupBy("service", F.floor(F.col("timestamp") / 86400).alias("day")).agg(F.max("z_score").alias("score"), F.min(1 - F.abs("z_score") / 100).alias("quality"), F.count("*").alias("n"))


@query("bas_16_anomaly_rows", "SELECT 'c1::shop::'||service||'::'||metric AS node, event_id, CAST(sign(z_score) AS DOUBLE) AS direction, greatest(least(z_score,8.0),0.0) AS anomaly, 'e'||event_id AS lineage FROM v_z")
def _(v):
    return scored(v).select(S.stable_id(F.lit("c1"), F.lit("shop"), F.col("service"), F.col("metric")).alias("node"), "event_id", F.signum("z_score").alias("direction"), S.anomaly(F.col("z_score"), 1, 8.0).alias("anomaly"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("lineage"))


@query("bas_17_healthy_history", "SELECT decision, service, count(*) AS n FROM (SELECT service, CASE WHEN z_score>=3 THEN 'not_healthy' WHEN 1-abs(z_score)/10 < 0.8 THEN 'low_quality' WHEN service IN ('svc1','svc2') THEN 'frozen' ELSE 'accepted' END AS decision FROM v_z) GROUP BY 1,2")
def _(v):
    frozen = v.incidents().where("incident_id in ('inc1','inc2')").select(F.col("root_service").alias("service"))
    state = F.when(F.col("z_score") >= 3, "alert").otherwise("healthy")
    h = B.healthy_history(scored(v), state, 1 - F.abs("z_score") / 10, 0.8, frozen, "service")
    return h.groupBy("decision", "service").agg(F.count("*").alias("n"))
