"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S

from .views import query

_FAMILY = "CASE WHEN metric LIKE 'cpu.%' THEN 'CPU' WHEN metric LIKE 'net.%' THEN 'network' WHEN metric LIKE 'io.%' THEN 'storage I/O' WHEN metric LIKE 'lock.%' THEN 'lock contention' WHEN metric LIKE 'memory.%' THEN 'memory' WHEN metric LIKE 'request.%' THEN 'load' ELSE 'unknown' END"


@query("fn_01_metric_family", f"SELECT service, {_FAMILY} AS family, count(*) AS n FROM v_metrics GROUP BY 1,2")
def _(v):
    return v.metrics().groupBy("service", S.metric_family(F.col("metric")).alias("family")).agg(F.count("*").alias("n"))


@query("fn_02_evidence_types", """SELECT metric, t AS evidence_type, CASE t WHEN 'Net' THEN 'network' WHEN 'IO' THEN 'storage I/O' WHEN 'Load' THEN 'load' ELSE t END AS root_type, count(*) AS n
 FROM (SELECT metric, CASE WHEN metric LIKE 'cpu.%' THEN 'CPU' WHEN metric LIKE 'net.%' THEN 'Net' WHEN metric LIKE 'io.%' THEN 'IO' ELSE 'Load' END AS t FROM v_metrics) GROUP BY 1,2,3""")
def _(v):
    m = v.metrics().withColumn("evidence_type", S.evidence_type(F.col("metric")))
    return m.groupBy("metric", "evidence_type", S.canonical_type(S.root_type(F.col("evidence_type"))).alias("root_type")).agg(F.count("*").alias("n"))


@query("fn_03_metric_weights", """SELECT service, metric, CASE metric WHEN 'cpu.throttled_usec' THEN 2.2 WHEN 'net.retrans' THEN 2.2 WHEN 'request.p99_latency_ms' THEN 0.6 WHEN 'request.error_rate' THEN 0.75 ELSE 1.0 END AS specificity,
 CASE metric WHEN 'cpu.throttled_usec' THEN 4.0 WHEN 'net.retrans' THEN 2.0 WHEN 'io.write_bytes' THEN 1.0 ELSE 0.25 END AS intervention,
 sum(greatest((value-100)/50,0) * CASE WHEN metric LIKE 'request.%' THEN 2.0 ELSE 0.8 END) AS alert_score FROM v_metrics GROUP BY 1,2,3,4""")
def _(v):
    c = F.col("metric")
    rows = v.metrics().withColumn("score", S.alert_score(c, (F.col("value") - 100) / 50))
    return rows.groupBy("service", "metric", S.specificity(c).alias("specificity"), S.intervention_weight(c).alias("intervention")).agg(F.sum("score").alias("alert_score"))


@query("fn_04_stable_ids", """SELECT DISTINCT 'c1::shop::'||service||'::'||metric AS node, service||'.'||metric AS short, service AS back_service, metric AS back_metric, 'c1::shop::'||service||'->'||node||'::tcp::'||metric AS edge FROM v_metrics""")
def _(v):
    m = v.metrics().select("service", "metric", "node").distinct()
    short = S.node_id(F.col("service"), F.col("metric"))
    back = S.split_node(short)
    c, n = F.lit("c1"), F.lit("shop")
    edge = S.edge_id(c, n, F.col("service"), F.col("node"), F.lit("tcp"), F.col("metric"))
    return m.select(S.stable_id(c, n, F.col("service"), F.col("metric")).alias("node"), short.alias("short"), back[0].alias("back_service"), back[1].alias("back_metric"), edge.alias("edge")).distinct()


@query("fn_05_dense_index", "SELECT service, node_id, dense_rank() OVER (PARTITION BY service ORDER BY node_id) - 1 AS position FROM (SELECT DISTINCT service, node_id FROM v_panel)")
def _(v):
    ids = v.panel().select("service", "node_id").distinct()
    return ids.withColumn("position", F.dense_rank().over(Window.partitionBy("service").orderBy("node_id")) - 1)


@query("fn_06_value_transforms", "SELECT event_id, ln(1+value) AS logged, greatest(least((value-100)/10, 8.0), 0.0) AS up, greatest(least((100-value)/10, 8.0), 0.0) AS down FROM v_metrics")
def _(v):
    z = (F.col("value") - 100) / 10
    return v.metrics().select("event_id", S.transformed(F.col("value"), "log1p").alias("logged"), S.anomaly(z, 1, 8.0).alias("up"), S.anomaly(z, -1, 8.0).alias("down"))


@query("fn_07_fingerprint", "SELECT event_id, sha256(event_id||chr(31)||service||chr(31)||metric) AS fingerprint FROM v_metrics")
def _(v):
    return v.metrics().select("event_id", S.fingerprint(F.col("event_id"), F.col("service"), F.col("metric")).alias("fingerprint"))


@query("fn_08_ipw_weight", "SELECT incident_id, event_id, least(20.0, 1/greatest(probability, 0.05)) AS weight FROM v_residuals")
def _(v):
    return v.residuals().select("incident_id", "event_id", S.ipw_weight(F.col("probability")).alias("weight"))


@query("fn_09_observation_quality", "SELECT service, hour, max(cum_count) AS total, avg(cum_count/(cum_count+2.0)*(1-0.1)*0.9) AS quality FROM v_bucket GROUP BY 1,2")
def _(v):
    q = S.observation_quality(F.col("cum_count") / (F.col("cum_count") + 2.0), F.lit(0.1), F.lit(0.9))
    return v.bucket().groupBy("service", "hour").agg(F.max("cum_count").alias("total"), F.avg(q).alias("quality"))


@query("fn_10_rare_strength", "SELECT service, least(greatest(count(*) FILTER (metric='request.error_rate')/(count(*)+1e-9)/0.25, 0.0), 1.0) AS strength FROM v_metrics GROUP BY 1")
def _(v):
    n = F.count(F.when(F.col("metric") == "request.error_rate", 1))
    return v.metrics().groupBy("service").agg(S.rare_strength(n, F.count("*"), 0.25).alias("strength"))


@query("fn_11_continuous_strength", """WITH h AS (SELECT service, count(*) AS n, median(value) AS med FROM v_metrics WHERE timestamp < 1705276800 GROUP BY 1),
 s AS (SELECT m.service, greatest(1.4826*median(abs(value-med)), 0.01) AS scale FROM v_metrics m JOIN h USING (service) WHERE timestamp < 1705276800 GROUP BY 1)
 SELECT event_id, CASE WHEN n < 10 THEN 0.0 ELSE greatest(least((value-med)/scale, 6.0), 0.0)/6.0 END AS strength FROM v_metrics JOIN h USING (service) JOIN s USING (service) WHERE timestamp >= 1705276800""")
def _(v):
    from faultline.operators.baselines import continuous_strength

    m = v.metrics()
    return continuous_strength(m.where("timestamp < 1705276800"), m.where("timestamp >= 1705276800"), ["service"], z_cap=6.0, least_samples=10, least_scale=0.01).select("event_id", "strength")


@query("fn_12_shrinkage", """WITH t AS (SELECT service, metric, sign(avg(residual))*greatest(abs(avg(residual))-0.02,0) AS x FROM v_residuals GROUP BY 1,2)
 SELECT service, metric, x AS soft, x*greatest(0, 1-0.05/(sqrt(sum(x*x) OVER (PARTITION BY service))+1e-12)) AS shrunk FROM t""")
def _(v):
    t = v.residuals().groupBy("service", "metric").agg(S.soft_threshold(F.avg("residual"), 0.02).alias("soft"))
    return t.withColumn("shrunk", S.group_shrink(F.col("soft"), Window.partitionBy("service"), 0.05))


@query("fn_13_noisy_or", "SELECT service, 1 - product(1 - value/1000) AS strength FROM (SELECT service, metric, avg(value) AS value FROM v_metrics GROUP BY 1,2) GROUP BY 1")
def _(v):
    t = v.metrics().groupBy("service", "metric").agg(F.avg("value").alias("value"))
    return t.groupBy("service").agg(S.noisy_or(F.collect_list(F.col("value") / 1000)).alias("strength"))


@query("fn_14_max_normalised", "SELECT service, metric, s/max(s) OVER (PARTITION BY service) AS share FROM (SELECT service, metric, sum(value) AS s FROM v_metrics GROUP BY 1,2)")
def _(v):
    t = v.metrics().groupBy("service", "metric").agg(F.sum("value").alias("s"))
    return t.select("service", "metric", S.max_normalised(F.col("s"), Window.partitionBy("service")).alias("share"))


@query("fn_15_top_support", """SELECT service, metric, least(greatest(sum(a)/max(k)/3, 0), 1) AS support FROM (SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY a DESC) AS r, greatest(1, CAST(floor(count(*) OVER (PARTITION BY service, metric)*0.2) AS BIGINT)) AS k
 FROM (SELECT service, metric, abs(residual) AS a FROM v_residuals)) WHERE r <= k GROUP BY 1,2""")
def _(v):
    return v.residuals().groupBy("service", "metric").agg(S.top_support(F.collect_list("residual"), 3.0).alias("support"))


@query("fn_16_pod_service", "SELECT DISTINCT service||'-'||substr(md5(instance),1,9)||'-'||substr(md5(instance),1,5) AS pod, service AS inferred FROM v_metrics")
def _(v):
    h = F.md5(F.col("instance").cast("binary"))
    pod = F.concat_ws("-", "service", F.substring(h, 1, 9), F.substring(h, 1, 5))
    return v.metrics().select(pod.alias("pod")).distinct().withColumn("inferred", S.pod_service(F.col("pod")))


@query("fn_17_canonical_names", "SELECT DISTINCT ' '||service||'.'||metric AS raw, metric AS metric_name, service AS service_name FROM v_metrics")
def _(v):
    raw = F.concat(F.lit(" "), F.col("service"), F.lit("."), F.col("metric"))
    return v.metrics().select(raw.alias("raw"), S.canonical_metric(raw).alias("metric_name"), S.canonical_service(F.concat(F.lit("  "), F.col("service"))).alias("service_name")).distinct()
