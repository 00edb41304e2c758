"""Queries for counters, histograms and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators import aggregation as A

from .views import DAY0, SQL, query

WIN = 86400.0
SQL["v_delta"] = "SELECT *, floor(timestamp/86400)*86400 AS win, CASE WHEN value<prev THEN NULL ELSE value-prev END AS delta, CASE WHEN prev IS NULL THEN 'no_history' WHEN value<prev THEN 'counter_reset' END AS issue FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp, event_id) AS prev FROM v_counter)"
SQL["v_hourly"] = "SELECT service, metric, node, floor(timestamp/86400)*86400 AS win, count(*) AS n, sum(value) AS total, max(value) AS top FROM v_metrics GROUP BY 1,2,3,4"


def deltas(v, policy="missing"):
    return A.counter_delta(v.counter(), "series_id", ["timestamp", "event_id"], policy).withColumn("win", A.tumbling(F.col("timestamp"), WIN))


def metrics(v):
    return v.metrics().withColumn("win", A.tumbling(F.col("timestamp"), WIN))


@query("agg_01_tumbling_windows", "SELECT service, floor(timestamp/86400)*86400 AS win, count(*) AS n, sum(value) AS total FROM v_metrics GROUP BY 1,2")
def _(v):
    return metrics(v).groupBy("service", "win").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("agg_02_counter_delta", "SELECT event_id, delta, issue FROM v_delta")
def _(v):
    return deltas(v).select("event_id", "delta", "issue")


@query("agg_03_reset_policies", "SELECT series_id, sum(CASE WHEN issue='counter_reset' THEN value ELSE delta END) AS taken, (SELECT count(*) FROM v_delta b WHERE b.series_id=a.series_id AND NOT EXISTS (SELECT 1 FROM v_delta c WHERE c.series_id=b.series_id AND c.win=b.win AND c.issue='counter_reset')) AS kept_rows FROM v_delta a GROUP BY 1")
def _(v):
    taken = deltas(v, "current").groupBy("series_id").agg(F.sum("delta").alias("taken"))
    d = deltas(v).withColumn("sw", F.concat_ws("@", "series_id", F.col("win").cast("string")))
    kept = A.reject_reset_windows(d, "sw").groupBy("series_id").agg(F.count("*").alias("kept_rows"))
    return taken.join(kept, "series_id", "left").fillna({"kept_rows": 0})


@query("agg_04_sum_same_unit", "SELECT service, win, CASE WHEN count(DISTINCT node)=1 THEN sum(value) END AS total, CASE WHEN count(DISTINCT node)>1 THEN 'mixed_units' END AS issue FROM (SELECT *, floor(timestamp/86400)*86400 AS win FROM v_metrics) GROUP BY 1,2")
def _(v):
    return A.sum_same_unit(metrics(v), ["service", "win"], "node")


@query("agg_05_median_max", "SELECT service, metric, 0.7*median(value)+0.3*max(value) AS value FROM v_metrics GROUP BY 1,2")
def _(v):
    return A.median_max(v.metrics(), ["service", "metric"], 0.7)


@query("agg_06_last_same_series", "SELECT instance, metric, timestamp AS last_at, max(value) AS value, count(DISTINCT value)>1 AS conflict FROM v_metrics m WHERE timestamp=(SELECT max(timestamp) FROM v_metrics k WHERE k.instance=m.instance AND k.metric=m.metric) GROUP BY 1,2,3")
def _(v):
    return A.last_value(v.metrics(), ["instance", "metric"], "timestamp")


@query("agg_07_ratio_from_components", "SELECT service, win, CASE WHEN d=0 AND n>0 THEN NULL WHEN d=0 THEN 0.0 ELSE n/(d+1e-9) END AS ratio, CASE WHEN d=0 AND n>0 THEN 'no_denominator' WHEN d=0 THEN 'no_coverage' ELSE 'ok' END AS status FROM (SELECT service, floor(timestamp/21600)*21600 AS win, count(*) FILTER (metric='request.error_rate') AS n, count(*) FILTER (metric='request.p99_latency_ms') AS d FROM v_metrics GROUP BY 1,2)")
def _(v):
    only = lambda m: F.count(F.when(F.col("metric") == m, 1))
    t = v.metrics().groupBy("service", A.tumbling(F.col("timestamp"), 21600.0).alias("win")).agg(only("request.error_rate").alias("n"), only("request.p99_latency_ms").alias("d"))
    r, s = A.safe_ratio(F.col("n"), F.col("d"))
    return t.select("service", "win", r.alias("ratio"), s.alias("status"))


_Q = "SELECT {k}, CASE WHEN total=0 THEN 0.0 WHEN hit='inf'::DOUBLE THEN last ELSE hit END AS value, CASE WHEN total=0 THEN 'empty' WHEN hit='inf'::DOUBLE THEN 'above_last_bound' END AS issue, total FROM (SELECT {k}, total, min(le) FILTER (c >= {q}*total) AS hit, max(le) FILTER (le < 'inf'::DOUBLE) AS last FROM (SELECT *, max(c) OVER (PARTITION BY {k}) AS total FROM ({s})) GROUP BY {k}, total)"


@query("agg_08_histogram_quantile", _Q.format(k="service", q=0.9, s="SELECT service, le, CAST(sum(cum_count) AS BIGINT) AS c FROM v_bucket GROUP BY 1,2"))
def _(v):
    merged = v.bucket().groupBy("service", "le").agg(F.sum("cum_count").alias("cum_count"))
    return A.histogram_quantile(merged, ["service"], 0.9)


@query("agg_09_reject_cross_scope", "SELECT service, metric, CASE WHEN count(DISTINCT node)>1 THEN 'cross_scope_quantile' ELSE 'ok' END AS status, CASE WHEN count(DISTINCT node)=1 THEN quantile_disc(value,0.95) END AS p95 FROM v_metrics GROUP BY 1,2")
def _(v):
    t = v.metrics().groupBy("service", "metric").agg(F.count_distinct("node").alias("scopes"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p"))
    return t.select("service", "metric", F.when(F.col("scopes") > 1, "cross_scope_quantile").otherwise("ok").alias("status"), F.when(F.col("scopes") == 1, F.col("p")).alias("p95"))


@query("agg_10_quality_rollup", "SELECT service, sum(greatest(n,1)*top/500)/sum(greatest(n,1)) AS coverage, sum(greatest(n,1)*0.1)/sum(greatest(n,1)) AS loss, CAST(sum(n) AS BIGINT) AS n FROM v_hourly GROUP BY 1")
def _(v):
    rows = metrics(v).groupBy("service", "metric", "node", "win").agg(F.count("*").alias("n"), (F.max("value") / 500).alias("coverage")).withColumn("loss", F.lit(0.1))
    return A.quality_rollup(rows, ["service"])


@query("agg_11_aggregation_plan", "SELECT service, sum(total)/sum(n) AS mean, max(top)/(sum(total)/sum(n)) AS peak FROM v_hourly GROUP BY 1")
def _(v):
    plan = {
        "peak": (["mean", "top"], lambda mean, top: mean.join(top, "service").select("service", "mean", (F.col("top") / F.col("mean")).alias("peak"))),
        "mean": (["rows"], lambda rows: rows.groupBy("service").agg(F.avg("value").alias("mean"))),
        "top": (["rows"], lambda rows: rows.groupBy("service").agg(F.max("value").alias("top"))),
    }
    return A.run_plan(plan, {"rows": v.metrics()})["peak"]


@query("agg_12_issue_tables", "SELECT issue, service, count(*) AS n FROM (SELECT service, issue FROM v_delta WHERE issue IS NOT NULL UNION ALL SELECT service, 'high_value' FROM v_metrics WHERE value>400) GROUP BY 1,2")
def _(v):
    a = deltas(v).where("issue is not null").select("service", "issue")
    b = v.metrics().where("value > 400").select("service", F.lit("high_value").alias("issue"))
    return a.unionByName(b).groupBy("issue", "service").agg(F.count("*").alias("n"))


@query("agg_13_boundary_delta", """WITH r AS (SELECT *, min(timestamp) OVER (PARTITION BY series_id) AS a, max(timestamp) OVER (PARTITION BY series_id) AS b FROM v_counter)
 SELECT service, series_id, CASE WHEN na=1 AND nb=1 AND d>=0 THEN d END AS delta, CASE WHEN na<>1 OR nb<>1 THEN 'boundary_samples' WHEN d<0 THEN 'counter_reset' END AS issue FROM (SELECT service, series_id, count(*) FILTER (timestamp=a) AS na, count(*) FILTER (timestamp=b) AS nb, sum(value) FILTER (timestamp=b)-sum(value) FILTER (timestamp=a) AS d FROM r GROUP BY 1,2)""")
def _(v):
    w = Window.partitionBy("series_id")
    rows = v.counter().withColumns({"a": F.min("timestamp").over(w), "b": F.max("timestamp").over(w)})
    return A.boundary_delta(rows, ["service"], "series_id", F.col("a"), F.col("b"))


@query("agg_14_latest_gauge", "SELECT service, metric, win, arg_max(value, timestamp) AS value, count(*) FILTER (timestamp=last)>1 AS tied FROM (SELECT *, max(timestamp) OVER (PARTITION BY service, metric, win) AS last FROM (SELECT *, floor(timestamp/86400)*86400 AS win FROM v_metrics)) GROUP BY 1,2,3")
def _(v):
    t = A.last_value(metrics(v), ["service", "metric", "win"], "timestamp")
    return t.select("service", "metric", "win", "value", F.col("conflict").alias("tied"))


@query("agg_15_series_sets_equal", "SELECT service, count(DISTINCT s)=1 AS equal, count(*) AS components FROM (SELECT service, metric, list_sort(list(DISTINCT node)) AS s FROM v_metrics GROUP BY 1,2) GROUP BY 1")
def _(v):
    return A.series_sets_equal(v.metrics(), ["service"], "metric", "node")


@query("agg_16_safe_ratio", "SELECT src, dst, month, CASE WHEN failed>n THEN NULL ELSE failed/(n+1e-9) END AS ratio, CASE WHEN failed>n THEN 'above_one' ELSE 'ok' END AS status FROM v_calls")
def _(v):
    r, s = A.safe_ratio(F.col("failed"), F.col("n"), bounded=True)
    return v.calls().select("src", "dst", "month", r.alias("ratio"), s.alias("status"))


@query("agg_17_bucket_p95", _Q.format(k="service, hour", q=0.95, s="SELECT service, hour, le, cum_count AS c FROM v_bucket"))
def _(v):
    return A.histogram_quantile(v.bucket(), ["service", "hour"], 0.95)


@query("agg_18_service_rollup", "SELECT dst AS service, month, count(*) AS requests, avg(failed) AS failure_rate, quantile_disc(latency,0.95) AS p95, max(latency) AS peak, sum(latency) AS busy, count(DISTINCT src) AS callers, least(sum(failed),count(*))/count(*) AS capped FROM v_call_rows GROUP BY 1,2")
def _(v):
    return v.call_rows().groupBy(F.col("dst").alias("service"), "month").agg(
        F.count("*").alias("requests"), F.avg("failed").alias("failure_rate"), F.expr("percentile_disc(0.95) within group (order by latency)").alias("p95"),
        F.max("latency").alias("peak"), F.sum("latency").alias("busy"), F.count_distinct("src").alias("callers"), (F.least(F.sum("failed"), F.count("*")) / F.count("*")).alias("capped"),
    )


@query("agg_19_host_rollup", "SELECT node, win, sum(CASE WHEN metric='cpu.throttled_usec' THEN total ELSE 0 END)/86400 AS cpu_share, sum(CASE WHEN metric='io.write_bytes' THEN total ELSE 0 END)/86400 AS io_share, sum(CASE WHEN metric='net.retrans' THEN total ELSE 0 END)/86400 AS net_rate, CAST(sum(n) AS BIGINT) AS samples FROM v_hourly GROUP BY 1,2")
def _(v):
    part = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")).otherwise(0.0)) / WIN
    return metrics(v).groupBy("node", "win").agg(part("cpu.throttled_usec").alias("cpu_share"), part("io.write_bytes").alias("io_share"), part("net.retrans").alias("net_rate"), F.count("*").alias("samples"))


@query("agg_20_tcp_edges", "SELECT g.src, g.dst, coalesce(n,0) AS n, p95, coalesce(failed,0) AS failed, CASE WHEN n IS NULL THEN 0.0 ELSE failed/(n+1e-9) END AS failure_rate, CASE WHEN n IS NULL THEN 'no_coverage' ELSE 'ok' END AS status FROM v_graph g LEFT JOIN (SELECT src, dst, count(*) AS n, quantile_disc(latency,0.95) AS p95, CAST(sum(failed) AS BIGINT) AS failed FROM v_call_rows GROUP BY 1,2) c ON c.src=g.src AND c.dst=g.dst")
def _(v):
    return A.edge_rollup(v.call_rows(), ["src", "dst"], v.graph().select("src", "dst"))


@query("agg_21_dns_edges", "SELECT src, dst, count(*) AS queries, sum(failed) AS timeouts, count(*)-sum(failed) AS responses, true AS balanced FROM v_call_rows GROUP BY 1,2")
def _(v):
    t = v.call_rows().groupBy("src", "dst").agg(F.count("*").alias("queries"), F.sum("failed").alias("timeouts"), F.sum(1 - F.col("failed")).alias("responses"))
    return t.withColumn("balanced", F.col("responses") + F.col("timeouts") == F.col("queries"))


@query("agg_22_window_result", "SELECT month, kind, count(*) AS rows, sum(value) AS value FROM (SELECT month, 'service' AS kind, avg(failed) AS value FROM v_call_rows GROUP BY month, dst UNION ALL SELECT month, 'edge', n FROM v_calls) GROUP BY 1,2")
def _(v):
    calls = v.call_rows()
    a = calls.groupBy("month", "dst").agg(F.avg("failed").alias("value")).select("month", F.lit("service").alias("kind"), "value")
    b = v.calls().select("month", F.lit("edge").alias("kind"), F.col("n").cast("double").alias("value"))
    return a.unionByName(b).groupBy("month", "kind").agg(F.count("*").alias("rows"), F.sum("value").alias("value"))


@query("agg_23_lineage", "SELECT service, array_to_string(list_sort(list(DISTINCT node)), ',') AS sources, min(value/500) AS coverage, max(value/1000) AS loss FROM v_metrics GROUP BY 1")
def _(v):
    rows = v.metrics().select("service", F.array("node").alias("ids"), (F.col("value") / 500).alias("coverage"), (F.col("value") / 1000).alias("loss"))
    return A.lineage(rows, ["service"], "ids").withColumn("sources", F.concat_ws(",", "sources"))


@query("agg_24_container_deltas", "SELECT service, win, sum(delta) FILTER (metric='cpu.throttled_usec') AS throttled, count(delta) FILTER (metric='cpu.throttled_usec') AS periods FROM v_delta GROUP BY 1,2")
def _(v):
    cpu = F.when(F.col("metric") == "cpu.throttled_usec", F.col("delta"))
    return deltas(v).groupBy("service", "win").agg(F.sum(cpu).alias("throttled"), F.count(cpu).alias("periods"))


@query("agg_25_filesystem_deltas", "SELECT service, win, sum(delta)/86400 AS write_rate, count(delta) AS samples FROM v_delta WHERE metric='io.write_bytes' GROUP BY 1,2")
def _(v):
    return deltas(v).where("metric = 'io.write_bytes'").groupBy("service", "win").agg((F.sum("delta") / WIN).alias("write_rate"), F.count("delta").alias("samples"))


@query("agg_26_request_summary", "SELECT src, count(*) AS n, avg(failed) AS error_rate, quantile_disc(latency,0.5) AS p50, quantile_disc(latency,0.95) AS p95, quantile_disc(latency,0.99) AS p99 FROM v_call_rows GROUP BY 1")
def _(v):
    return A.request_summary(v.call_rows(), ["src"], "latency", "failed")


_LIFT = "SELECT service, metric, avg(value) FILTER (NOT f) AS baseline_mean, avg(value) FILTER (f) AS faulty_mean, stddev_pop(value) FILTER (NOT f) AS baseline_std, stddev_pop(value) FILTER (f) AS faulty_std, avg(value) FILTER (f)-avg(value) FILTER (NOT f) AS lift FROM (SELECT *, timestamp>=1705276800 AS f FROM v_metrics) GROUP BY 1,2"
SQL["v_lift"] = _LIFT


def lifted(v):
    return A.phase_lift(v.metrics(), ["service", "metric"], F.col("timestamp") >= DAY0 + 14 * 86400)


@query("agg_27_phase_lift", "SELECT *, row_number() OVER (ORDER BY lift DESC, service, metric) AS rank FROM v_lift")
def _(v):
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("lift"), "service", "metric")  # one row for each service and metric
    return lifted(v).withColumn("rank", F.row_number().over(w))


@query("agg_28_network_deltas", "SELECT service, kind, win, sum(delta) AS value FROM (SELECT service, win, 'net.retrans.delta' AS kind, delta FROM v_delta WHERE metric='net.retrans' AND delta IS NOT NULL) GROUP BY 1,2,3")
def _(v):
    rows = deltas(v).where("metric = 'net.retrans' and delta is not null")
    return rows.groupBy("service", F.concat(F.col("metric"), F.lit(".delta")).alias("kind"), "win").agg(F.sum("delta").alias("value"))


@query("agg_29_lift_evidence", "SELECT service, metric, lift AS value, 'lift' AS evidence_type FROM v_lift WHERE metric IN ('net.retrans','io.write_bytes','cpu.throttled_usec') AND lift>0")
def _(v):
    return lifted(v).where("metric in ('net.retrans', 'io.write_bytes', 'cpu.throttled_usec') and lift > 0").select("service", "metric", F.col("lift").alias("value"), F.lit("lift").alias("evidence_type"))


@query("agg_30_quality_report", "SELECT service, count(DISTINCT metric) AS metrics, count(*) FILTER (timestamp>=1705276800) AS faulty_rows, count(*) FILTER (timestamp<1705276800) AS baseline_rows, count(DISTINCT metric)=5 AND count(*) FILTER (timestamp>=1705276800)>0 AS passed FROM v_metrics GROUP BY 1")
def _(v):
    faulty = F.col("timestamp") >= DAY0 + 14 * 86400
    t = v.metrics().groupBy("service").agg(F.count_distinct("metric").alias("metrics"), F.count(F.when(faulty, 1)).alias("faulty_rows"), F.count(F.when(~faulty, 1)).alias("baseline_rows"))
    return t.withColumn("passed", (F.col("metrics") == 5) & (F.col("faulty_rows") > 0))


@query("agg_31_request_rows", "SELECT src, dst, month, count(*) AS n, count(*) FILTER (failed=1) AS errors, count(*) FILTER (failed=0 AND latency>=45) AS timeouts FROM v_call_rows WHERE src<>dst GROUP BY 1,2,3")
def _(v):
    kind = F.when(F.col("failed") == 1, "error").when(F.col("latency") >= 45, "timeout").otherwise("ok")
    t = v.call_rows().where("src <> dst").withColumn("kind", kind)
    return t.groupBy("src", "dst", "month").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "error", 1)).alias("errors"), F.count(F.when(F.col("kind") == "timeout", 1)).alias("timeouts"))


@query("agg_32_dns_records", "SELECT dst, le, count(*) FILTER (latency<=le) AS cum_count, least(count(*) FILTER (failed=1), count(*)) AS errors FROM v_call_rows CROSS JOIN (SELECT unnest([10.0,20.0,30.0,40.0,50.0]::DOUBLE[]) AS le) GROUP BY 1,2")
def _(v):
    rows = v.call_rows().select("dst", "latency", "failed", F.explode(F.array(*[F.lit(x) for x in (10.0, 20.0, 30.0, 40.0, 50.0)])).alias("le"))
    return rows.groupBy("dst", "le").agg(F.count(F.when(F.col("latency") <= F.col("le"), 1)).alias("cum_count"), F.least(F.sum("failed"), F.count("*")).alias("errors"))


@query("agg_33_host_samples", "SELECT node, component, sum(value)*1000 AS nanos, count(*) AS n FROM (SELECT node, value, CASE metric WHEN 'cpu.throttled_usec' THEN 'host.cpu' WHEN 'io.write_bytes' THEN 'host.io' WHEN 'net.retrans' THEN 'host.net' END AS component FROM v_metrics) WHERE component IS NOT NULL GROUP BY 1,2")
def _(v):
    names = F.create_map(*[F.lit(x) for x in ("cpu.throttled_usec", "host.cpu", "io.write_bytes", "host.io", "net.retrans", "host.net")])
    rows = v.metrics().withColumn("component", names[F.col("metric")]).where("component is not null")
    return rows.groupBy("node", "component").agg((F.sum("value") * 1000).alias("nanos"), F.count("*").alias("n"))


@query("agg_34_high_water", """WITH s AS (SELECT service||'/'||metric AS series, floor(timestamp/86400)*86400 AS snap, max(value) AS value FROM v_metrics WHERE value>50 GROUP BY 1,2), sp AS (SELECT DISTINCT snap FROM s), f AS (SELECT series, min(snap) AS first FROM s GROUP BY 1)
 SELECT f.series, sp.snap, max(value) OVER (PARTITION BY f.series ORDER BY sp.snap) AS high FROM f JOIN sp ON sp.snap>=first LEFT JOIN s ON s.series=f.series AND s.snap=sp.snap""")
def _(v):
    rows = metrics(v).where("value > 50").select(F.concat_ws("/", "service", "metric").alias("series"), F.col("win").alias("snap"), "value")
    return A.high_water(rows, "series", "snap", "value", rows.select("snap").distinct())
