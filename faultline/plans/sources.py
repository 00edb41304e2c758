"""Queries for sources and validation, over the given tables and what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import validation as V
from faultline.sources import records as R

from .views import SQL, query

SQL["v_lines"] = """SELECT event_id, CASE WHEN event_id%50=0 THEN '# HELP '||metric ELSE replace(metric,'.','_')||'{service="'||service||'",pod="p'||instance||'"} '||CAST(event_id AS VARCHAR)||' '||CAST(CAST(floor(timestamp) AS BIGINT)*1000 AS VARCHAR) END AS line FROM v_metrics"""


def lines(v):
    m = v.metrics()
    text = F.concat(F.translate("metric", ".", "_"), F.lit('{service="'), "service", F.lit('",pod="p'), "instance", F.lit('"} '), F.col("event_id").cast("string"), F.lit(" "), (F.floor("timestamp") * 1000).cast("string"))
    return m.select("event_id", "metric", "service", "instance", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("# HELP "), "metric")).otherwise(text).alias("line"))


@query("src_03_mixed_log", "SELECT service, count(*) AS n, sum(value) AS total FROM v_metrics WHERE metric LIKE 'request.%' GROUP BY 1")
def _(v):
    m = v.metrics()
    log = R.enveloped("request", m.where("metric like 'request.%'").select("service", "value")).unionByName(R.enveloped("resource", m.where("metric not like 'request.%'").select("service", "value")))
    return R.routed(log, "request", "service string, value double").groupBy("service").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("src_05_exposition_text", "SELECT event_id, CASE WHEN event_id%50=0 THEN NULL ELSE replace(metric,'.','_') END AS name, CASE WHEN event_id%50=0 THEN NULL ELSE service END AS service, CASE WHEN event_id%50=0 THEN NULL ELSE event_id END::DOUBLE AS value FROM v_metrics")
def _(v):
    p = R.exposition(F.col("line"))
    return lines(v).select("event_id", p["name"].alias("name"), p["labels"]["service"].alias("service"), p["value"].alias("value"))


@query("src_08_typed_records", "SELECT event_id, 'c1::shop::'||service||'::'||metric AS node, value, CASE WHEN metric LIKE 'request.%' THEN 'gauge' ELSE 'delta_counter' END AS kind FROM v_metrics")
def _(v):
    kind = F.when(F.col("metric").startswith("request."), "gauge").otherwise("delta_counter")
    return v.metrics().select("event_id", S.stable_id(F.lit("c1"), F.lit("shop"), F.col("service"), F.col("metric")).alias("node"), "value", kind.alias("kind"))


@query("src_09_call_edges", "SELECT src, dst, month, sum(latency) AS total, count(*) AS samples FROM (SELECT DISTINCT src, dst, month, request_id, line, latency FROM v_call_rows) GROUP BY 1,2,3 HAVING sum(latency)>0")
def _(v):
    rows = v.call_rows(dealt=True).select("src", "dst", "month", "request_id", "line", "latency").distinct()
    return rows.groupBy("src", "dst", "month").agg(F.sum("latency").alias("total"), F.count("*").alias("samples")).where("total > 0")


@query("src_10_kernel_events", "SELECT metric AS type, count(*) AS n, sum(value) AS total FROM v_metrics GROUP BY 1")
def _(v):
    j = v.metrics().select(F.to_json(F.struct("event_id", F.col("metric").alias("type"), F.col("instance").alias("cgroup"), "value")).alias("line"))
    e = j.select(R.kernel_events(F.col("line")).alias("e")).select("e.*").where("event_id is not null")
    return e.groupBy("type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("src_11_event_windows", """WITH t AS (SELECT event_id, CAST(floor(timestamp/3600) AS BIGINT) AS w, metric LIKE 'request.%' AS m FROM v_metrics), f AS (SELECT DISTINCT w FROM t WHERE m) SELECT event_id, (SELECT min(f.w) FROM f WHERE f.w>=t.w) AS "window" FROM t""")
def _(v):
    return R.event_windows(v.metrics(), F.col("timestamp"), 3600.0, F.col("metric").startswith("request.")).select("event_id", "window")


@query("src_12_deduplicate", "SELECT instance, metric, count(*) AS copies, count(DISTINCT service)>1 AS conflict FROM v_metrics GROUP BY 1,2")
def _(v):
    return R.deduplicated(v.metrics(), ["instance", "metric"], ["service"])


@query("src_13_order_audit", "SELECT service, count(*) FILTER (late) AS late FROM (SELECT service, coalesce(value < max(value) OVER (PARTITION BY service ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM v_metrics) GROUP BY 1")
def _(v):
    return R.out_of_order(v.metrics(), "service", "event_id", "value").groupBy("service").agg(F.count(F.when(F.col("late"), 1)).alias("late"))


@query("src_15_change_log", "SELECT instance, metric AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY timestamp DESC, event_id DESC) AS r FROM v_metrics) WHERE r=1 AND metric<>'io.write_bytes'")
def _(v):
    log = v.metrics().withColumn("event", F.when(F.col("metric") == "io.write_bytes", "DELETED").otherwise("MODIFIED"))
    return R.current_objects(log, "instance", ["timestamp", "event_id"], "event").select("instance", F.col("metric").alias("state"), "event_id")


@query("src_17_owner_chains", "SELECT 'c'||c_custkey AS start, r_name AS owner, 2 AS depth, false AS cycle FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey")
def _(v):
    c, n, r = v.table("customer"), v.table("nation"), v.table("region")
    ids = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    up = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(ids.alias("child"), F.concat(F.lit("n:"), "n_name").alias("parent"))
    top = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), "n_name").alias("child"), F.col("r_name").alias("parent"))
    return R.cgroup_owner(c.select(ids.alias("start")), up.unionByName(top))


@query("src_19_topology_snapshot", "SELECT snapshot_id, count(*) AS edges, sha256(string_agg(src||'>'||dst, ',' ORDER BY src||'>'||dst)) AS fingerprint FROM v_snapshots GROUP BY 1")
def _(v):
    edge = F.concat("src", F.lit(">"), "dst")
    return v.snapshots().groupBy("snapshot_id").agg(F.count("*").alias("edges"), F.sha2(F.array_join(F.sort_array(F.collect_list(edge)), ","), 256).alias("fingerprint"))


@query("src_22_report_sink", "SELECT action, count(*) AS n FROM (SELECT CASE WHEN event_id%3=0 THEN 'new' WHEN event_id%3=1 THEN 'unchanged' ELSE 'conflict' END AS action FROM v_metrics) GROUP BY 1")
def _(v):
    m = v.metrics().select("event_id", "value")
    old = m.where("event_id % 3 > 0").withColumn("value", F.when(F.col("event_id") % 3 == 2, F.col("value") + 1).otherwise(F.col("value")))
    return R.reports_to_write(m, old, "event_id", "value").groupBy("action").agg(F.count("*").alias("n"))


@query("src_23_attach_incident", "SELECT i.incident_id, metric, count(*) AS n FROM v_metrics JOIN v_incidents i ON timestamp>=start_ts AND timestamp<end_ts GROUP BY 1,2")
def _(v):
    i = v.incidents().select(F.col("incident_id").alias("inc"), "start_ts", "end_ts")
    j = v.metrics().join(i, (F.col("timestamp") >= F.col("start_ts")) & (F.col("timestamp") < F.col("end_ts")))
    return j.groupBy(F.col("inc").alias("incident_id"), "metric").agg(F.count("*").alias("n"))


@query("src_24_primitive_samples", "SELECT metric AS component, sha256(service||chr(31)||instance) AS series_id, count(*) AS n, sum(value)*1000 AS scaled FROM v_metrics GROUP BY 1,2")
def _(v):
    return v.metrics().groupBy(F.col("metric").alias("component"), S.fingerprint(F.col("service"), F.col("instance")).alias("series_id")).agg(F.count("*").alias("n"), (F.sum("value") * 1000).alias("scaled"))


@query("src_25_source_union", "SELECT origin, count(*) AS n FROM (SELECT 'events' AS origin FROM v_metrics UNION ALL SELECT 'calls' FROM v_call_rows) GROUP BY 1")
def _(v):
    return v.metrics().select(F.lit("events").alias("origin")).unionByName(v.call_rows().select(F.lit("calls").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))


@query("src_27_registry_records", "SELECT metric, kind, count(*) AS n FROM v_metrics JOIN (VALUES ('request.error_rate','gauge'),('cpu.throttled_usec','monotonic_counter'),('net.retrans','monotonic_counter')) r(m, kind) ON m=metric GROUP BY 1,2")
def _(v):
    reg = v.spark.createDataFrame([("request.error_rate", "gauge"), ("cpu.throttled_usec", "monotonic_counter"), ("net.retrans", "monotonic_counter")], "metric string, kind string")
    return v.metrics().join(F.broadcast(reg), "metric").groupBy("metric", "kind").agg(F.count("*").alias("n"))


# --- validation

@query("val_01_record_rules", "SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN NOT value BETWEEN 1 AND 400 THEN 'range' END, CASE WHEN metric NOT LIKE 'request.%' AND metric NOT LIKE 'cpu.%' THEN 'family' END) AS reasons FROM v_metrics) GROUP BY 1")
def _(v):
    rules = {"range": F.col("value").between(1, 400), "family": F.col("metric").startswith("request.") | F.col("metric").startswith("cpu.")}
    return V.with_reasons(v.metrics(), rules).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("val_02_component_contract", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN metric='io.write_bytes' THEN 'undeclared' WHEN metric='net.retrans' AND node<>'node1' THEN 'differs:node' END AS problem FROM v_metrics) GROUP BY 1")
def _(v):
    m = v.metrics().select("metric", F.when(F.col("metric") == "net.retrans", F.col("node")).otherwise("any").alias("node"))
    d = v.spark.createDataFrame([("net.retrans", "node1"), ("request.error_rate", "any"), ("request.p99_latency_ms", "any"), ("cpu.throttled_usec", "any")], "metric string, node string")
    return V.contract(m, d, ["metric"], ["node"]).groupBy("problem").agg(F.count("*").alias("n"))


@query("val_03_single_role", "SELECT metric, CASE WHEN metric LIKE 'request.%' THEN 1 WHEN metric LIKE '%t%' THEN 2 ELSE 0 END AS roles, count(*) AS n FROM v_metrics GROUP BY 1,2")
def _(v):
    roles = F.when(F.col("metric").startswith("request."), 1).when(F.col("metric").contains("t"), 2).otherwise(0)
    return v.metrics().groupBy("metric", roles.alias("roles")).agg(F.count("*").alias("n"))


@query("val_04_complete_sets", "SELECT service, win, array_to_string(list_sort(list_filter((SELECT list(DISTINCT metric) FROM v_metrics), lambda x: NOT list_contains(have, x))), ',') AS missing FROM (SELECT service, CAST(floor(timestamp/21600) AS BIGINT) AS win, list(DISTINCT metric) AS have FROM v_metrics GROUP BY 1,2)")
def _(v):
    m = v.metrics().withColumn("win", F.floor(F.col("timestamp") / 21600))
    return V.complete_sets(m, ["service", "win"], "metric", m.select("metric").distinct()).select("service", "win", F.array_join("missing", ",").alias("missing"))


@query("val_06_topology_coverage", "SELECT coalesce(a.snapshot_id,b.snapshot_id) AS snapshot_id, coalesce(a.src,b.src) AS src, coalesce(a.dst,b.dst) AS dst, CASE WHEN b.src IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT y.snapshot_id, g.src, g.dst FROM (SELECT DISTINCT src, dst FROM v_graph WHERE edge_type='trace') g CROSS JOIN (SELECT DISTINCT snapshot_id FROM v_snapshots) y) a FULL JOIN (SELECT DISTINCT snapshot_id, src, dst FROM v_snapshots) b ON a.snapshot_id=b.snapshot_id AND a.src=b.src AND a.dst=b.dst WHERE a.src IS NULL OR b.src IS NULL")
def _(v):
    edges = v.graph().where("edge_type = 'trace'").select("src", "dst")
    years = v.snapshots().select("snapshot_id").distinct()  # one row a snapshot: the grid is each snapshot's expected edges
    return V.coverage(edges.crossJoin(years), v.snapshots(), ["snapshot_id", "src", "dst"])


@query("val_07_topology_versions", "SELECT snapshot_id, count(DISTINCT valid_from) AS versions, max(valid_to)>min(valid_from) AS ordered FROM v_snapshots GROUP BY 1")
def _(v):
    return v.snapshots().groupBy("snapshot_id").agg(F.count_distinct("valid_from").alias("versions"), (F.max("valid_to") > F.min("valid_from")).alias("ordered"))


@query("val_08_archive_order", "SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN day-lag(day) OVER w<>1 THEN 'sequence' END, CASE WHEN valid_to-valid_from>80000 THEN 'length' END, CASE WHEN lag(valid_to) OVER w>valid_from THEN 'overlap' END) AS reasons FROM v_intervals WINDOW w AS (PARTITION BY cgroup ORDER BY day)) GROUP BY 1")
def _(v):
    return V.sequence_rules(v.intervals(), "cgroup", "day", "valid_from", "valid_to", 80000.0).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("val_09_label_leaks", "SELECT metric, count(*) FILTER (metric='cpu.throttled_usec') AS leaks FROM v_metrics GROUP BY 1")
def _(v):
    leak = F.when(F.col("metric") == "cpu.throttled_usec", F.to_json(F.struct(F.struct(F.col("service").alias("Root_Service")).alias("x")))).otherwise(F.to_json(F.struct("service", "value")))
    return v.metrics().withColumn("leak", V.leaks(leak, ("root_service", "root_metric", "injected_path"))).groupBy("metric").agg(F.count(F.when(F.col("leak"), 1)).alias("leaks"))


@query("val_10_ownership", "SELECT CASE WHEN event_id%10=0 THEN 'service_mismatch' END AS issue, event_id%10<>0 AS valid, count(*) AS n, count(DISTINCT service) AS services FROM v_metrics GROUP BY 1,2")
def _(v):
    m = v.metrics().withColumn("node_id", F.concat_ws(".", "service", "metric")).withColumn("service", F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.col("service")))
    return V.ownership(m, "node_id", "service", "metric").groupBy("issue", "valid").agg(F.count("*").alias("n"), F.count_distinct("service_fixed").alias("services"))
