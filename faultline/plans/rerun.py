"""Queries for blind reruns and for records that come through files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import rerun as R
from faultline.operators import validation as V
from faultline.operators.tables import scratch
from faultline.sources import records as Q

from . import evidence, lifecycle  # noqa: F401  evidence defines views that are renamed here
from .views import SQL, query

#: Each service's alerts are a run, each hard alert an incident of one window.
SQL["v_bwindows"] = "SELECT service AS run_id, service||'@'||win AS incident_id, win*21600.0::DOUBLE AS start_ts, (win+1)*21600.0::DOUBLE AS end_ts FROM v_ctimeline WHERE state='hard' AND previous<>'hard'"
SQL["v_bnear"] = "SELECT incident_id, m.*, start_ts, end_ts FROM (SELECT * EXCLUDE (incident_id) FROM v_metrics) m JOIN v_bwindows ON timestamp>=start_ts-86400 AND timestamp<=end_ts"
SQL["v_bresiduals"] = """SELECT incident_id, event_id, timestamp, n.service, n.metric, (value-mu)/sd AS residual, CASE WHEN n.metric LIKE 'request.%' THEN 1.0 WHEN n.metric='cpu.throttled_usec' THEN 0.4 ELSE 0.1 END AS probability, start_ts, end_ts
 FROM v_bnear n JOIN (SELECT service, metric, avg(value) AS mu, stddev_pop(value) AS sd FROM v_metrics GROUP BY 1,2) s ON s.service=n.service AND s.metric=n.metric"""
SQL["v_bblind"] = """SELECT *, a-b AS absolute_lift FROM (SELECT incident_id, service, metric, avg(value) FILTER (timestamp<start_ts) AS b, avg(value) FILTER (timestamp>=start_ts) AS a,
 CASE metric WHEN 'cpu.throttled_usec' THEN 'CPU' WHEN 'net.retrans' THEN 'network' WHEN 'io.write_bytes' THEN 'storage I/O' ELSE 'load' END AS evidence_type FROM v_bnear GROUP BY 1,2,3) WHERE a IS NOT NULL AND b IS NOT NULL"""
SQL["v_bevidence"] = """SELECT incident_id, service, metric, evidence_score AS value FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, evidence_type ORDER BY evidence_score DESC, absolute_lift DESC, service, metric) AS r FROM (SELECT *, absolute_lift/max(absolute_lift) OVER (PARTITION BY incident_id, evidence_type) AS evidence_score FROM v_bblind WHERE absolute_lift>0) WHERE evidence_score>=0.3) WHERE r<=3"""
SQL["v_bipw"] = SQL["v_ipw"].replace("v_residuals", "v_bresiduals")
SQL["v_bkind"] = SQL["v_kind"].replace("v_evidence", "v_bevidence")
SQL["v_bsem"] = SQL["v_sem"].replace("v_sparse", "v_bipw").replace("v_evidence", "v_bevidence").replace("v_kind", "v_bkind")


@query("dia_25_blind_rerun", "SELECT run_id, incident_id, service, metric, intervention_score, evidence_score, semantic_score, semantic_rank FROM v_bsem JOIN v_bwindows USING (incident_id)")
def _(v):
    hard = lifecycle.timeline(v).where("state = 'hard' and previous <> 'hard'")
    start = F.col("win") * 21600.0
    windows = hard.select(F.col("service").alias("run_id"), F.concat_ws("@", "service", F.col("win").cast("string")).alias("incident_id"), start.alias("start_ts"), (start + 21600.0).alias("end_ts"))
    m = v.metrics()
    stats = m.groupBy("service", "metric").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    p = F.when(F.col("metric").startswith("request."), 1.0).when(F.col("metric") == "cpu.throttled_usec", 0.4).otherwise(0.1)
    rows = m.join(stats, ["service", "metric"]).select("service", "metric", "timestamp", "value", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("residual"), p.alias("probability"))
    return R.rerun(rows, windows, 86400.0, 21600.0)


@query("src_01_jsonl_tables", "SELECT service, metric, count(*) AS n, sum(value) AS total, count(incident_id) AS labelled FROM v_metrics GROUP BY 1,2")
def _(v):
    folder = scratch(v.spark, "jsonl")
    Q.write_jsonl(v.metrics().drop("event_id"), folder)
    v.spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(folder)
    return Q.read_jsonl(v.spark, folder, Q.METRIC).groupBy("service", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("incident_id").alias("labelled"))


@query("src_02_jsonl_lines", "SELECT metric, count(*) AS lines, count(*) AS in_order FROM v_metrics GROUP BY 1")
def _(v):
    folder = scratch(v.spark, "jsonl")
    Q.write_jsonl(v.metrics(), folder)
    keys = F.json_object_keys("value")
    return v.spark.read.text(folder).groupBy(F.get_json_object("value", "$.metric").alias("metric")).agg(F.count("*").alias("lines"), F.count_if(keys == F.array_sort(keys)).alias("in_order"))


@query("src_04_typed_parquet", "SELECT service, metric, CAST(sum(len(w)) AS BIGINT) AS wins, max(n) AS top FROM (SELECT service, metric, instance, list(event_id) AS w, count(*) AS n FROM v_metrics GROUP BY 1,2,3) GROUP BY 1,2")
def _(v):
    rows = v.metrics().groupBy("service", "metric", "instance").agg(F.array_sort(F.collect_list("event_id")).alias("ids"), F.create_map(F.lit("n"), F.count("*")).alias("counts"))
    path = scratch(v.spark, "typed")
    Q.write_table(rows, path, T.StructType(rows.schema.fields))
    back = v.spark.read.parquet(path)
    return back.groupBy("service", "metric").agg(F.sum(F.size("ids")).alias("wins"), F.max(F.col("counts")["n"]).alias("top"))


@query("src_09_conflicting_samples", """WITH i AS (SELECT src, dst, month, request_id, count(DISTINCT latency) AS kinds, min(latency) AS latency FROM v_call_rows GROUP BY 1,2,3,4)
 SELECT src, dst, month, coalesce(sum(latency) FILTER (kinds=1), 0) AS total, count(*) FILTER (kinds=1) AS samples, count(*) FILTER (kinds>1) AS conflicts, min(request_id) FILTER (kinds=1) AS first_source, max(request_id) FILTER (kinds=1) AS last_source, CAST(sum(request_id%1000003) FILTER (kinds=1) AS BIGINT) AS sources FROM i GROUP BY 1,2,3""")
def _(v):
    return Q.call_edges(v.call_rows(dealt=True), ["src", "dst", "month"], "request_id", "latency")


@query("val_03_metric_roles", """WITH r AS (SELECT * FROM (VALUES ('symptom', 'request.', ['events'], 'load'), ('latency', 'request.p99', ['events'], 'load'), ('cause', 'cpu.', ['events'], 'CPU'), ('cause', 'io.', ['probe'], 'storage I/O')) t(role, prefix, sources, family)),
 j AS (SELECT m.metric, m.source, CASE WHEN m.metric LIKE 'cpu.%' THEN 'CPU' WHEN m.metric LIKE 'net.%' THEN 'network' WHEN m.metric LIKE 'io.%' THEN 'storage I/O' ELSE 'load' END AS family, list_sort(list(r.role) FILTER (r.role IS NOT NULL)) AS roles, n FROM (SELECT metric, source, count(*) AS n FROM v_metrics GROUP BY 1,2) m LEFT JOIN r ON starts_with(m.metric, r.prefix) AND list_contains(r.sources, m.source) GROUP BY 1,2,3,n)
 SELECT metric, CASE WHEN roles IS NULL OR len(roles)=0 THEN 'no_role' WHEN len(roles)>1 THEN 'several_roles' ELSE 'ok' END AS problem, coalesce(array_to_string(roles, ','), '') AS roles, n FROM j""")
def _(v):
    roles = v.spark.createDataFrame([("symptom", "request.", ["events"], "load"), ("latency", "request.p99", ["events"], "load"), ("cause", "cpu.", ["events"], "CPU"), ("cause", "io.", ["probe"], "storage I/O")], "role string, prefix string, sources array<string>, family string")
    kinds = v.metrics().groupBy("metric", "source").agg(F.count("*").alias("n"))
    return V.single_role(kinds, roles).select("metric", "problem", F.concat_ws(",", "roles").alias("roles"), "n")
