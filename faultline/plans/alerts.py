"""Queries for alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import alerts as A

from .baselines import scored
from .views import SQL, query

STEP = 1800.0
SQL["v_events"] = """SELECT *, CASE WHEN metric LIKE 'request.%' THEN greatest(z_score,0)*2.0 ELSE greatest(z_score,0)*0.8 END AS alert_score, CASE WHEN len(reasons)>0 THEN 'hard' ELSE 'soft' END AS severity FROM (
 SELECT q.event_id, q.timestamp, q.service, q.metric, q.value, q.z_score, streak, list_filter([CASE WHEN z_score>=4 THEN 'z' END, CASE WHEN streak>=2 THEN 'consecutive' END, CASE WHEN resources IS NOT NULL THEN 'resource' END], lambda x: x IS NOT NULL) AS reasons, resources FROM v_streaks q
 LEFT JOIN (SELECT a.event_id, list_sort(list(DISTINCT b.service||'.'||b.metric)) AS resources FROM v_streaks a JOIN v_z b ON abs(a.timestamp-b.timestamp)<=1800 WHERE a.metric LIKE 'request.%' AND a.z_score>=2.5 AND b.metric NOT LIKE 'request.%' AND b.z_score>=2.5 GROUP BY 1) r USING (event_id)
 WHERE q.metric LIKE 'request.%' AND q.z_score>=2.5)"""
SQL["v_streaks"] = """SELECT *, CAST(sum(CASE WHEN hi THEN 1 ELSE 0 END) OVER (PARTITION BY service, metric, isl ORDER BY timestamp, event_id) AS BIGINT) AS streak FROM (
 SELECT *, sum(CASE WHEN hi THEN 0 ELSE 1 END) OVER (PARTITION BY service, metric ORDER BY timestamp, event_id) AS isl FROM (SELECT *, metric='request.p99_latency_ms' AND z_score>=2.5 AS hi FROM v_z))"""
SQL["v_numbered"] = """SELECT *, CAST(sum(o) OVER (ORDER BY timestamp, event_id) AS BIGINT) AS window_no FROM (SELECT *, CASE WHEN timestamp-30 <= max(timestamp+60) OVER (ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM v_events)"""
_WIN = "SELECT window_no, min(timestamp)-30 AS start_ts, max(timestamp)+60 AS end_ts, max(z_score) AS max_z, count(*) AS event_count, CASE WHEN bool_or(severity='hard') THEN 'hard' ELSE 'soft' END AS severity, array_to_string(list_sort(list(DISTINCT service||'.'||metric)), ',') AS triggers FROM v_numbered GROUP BY 1"
SQL["v_windows"] = _WIN


def events(v):
    return A.detect(scored(v), STEP, soft=2.5, hard=4.0)


def numbered(v):
    return A.alert_windows(events(v))


def windows(v):
    return A.window_summary(numbered(v))


@query("alr_01_streaks", "SELECT event_id, streak FROM v_streaks")
def _(v):
    hi = (F.col("metric") == "request.p99_latency_ms") & (F.col("z_score") >= 2.5)
    return A.streaks(scored(v), ["service", "metric"], ["timestamp", "event_id"], hi).select("event_id", "streak")


SQL["v_daily"] = "SELECT service, CAST(floor(timestamp/21600) AS BIGINT) AS win, metric, max(z_score) AS score FROM v_z GROUP BY 1,2,3"


def daily(v):
    return scored(v).groupBy("service", F.floor(F.col("timestamp") / 21600).alias("win"), "metric").agg(F.max("z_score").alias("score"))


@query("alr_02_composite_rules", """WITH s AS (SELECT * FROM (VALUES ('both','all',2,'request.error_rate',1.0),('both','all',2,'request.p99_latency_ms',1.0),('either','any',2,'cpu.throttled_usec',1.5),('either','any',2,'net.retrans',1.5)) t(rule,mode,parts,metric,least)),
 f AS (SELECT service, win, rule, mode, CASE WHEN mode='all' THEN count(DISTINCT metric)>=parts ELSE true END AS fired FROM v_daily JOIN s USING (metric) WHERE score>least GROUP BY service, win, rule, mode, parts),
 i AS (SELECT *, sum(CASE WHEN fired THEN 0 ELSE 1 END) OVER (PARTITION BY service, rule ORDER BY win) AS isl FROM f)
 SELECT service, rule, win, CAST(sum(CASE WHEN fired THEN 1 ELSE 0 END) OVER (PARTITION BY service, rule, isl ORDER BY win) AS BIGINT) AS streak FROM i""")
def _(v):
    rules = v.spark.createDataFrame([("both", "all", 2, "request.error_rate", 1.0), ("both", "all", 2, "request.p99_latency_ms", 1.0), ("either", "any", 2, "cpu.throttled_usec", 1.5), ("either", "any", 2, "net.retrans", 1.5)], "rule string, mode string, parts int, metric string, least double")
    return A.composite(daily(v), ["service"], "win", rules, 2).select("service", "rule", "win", "streak")


@query("alr_03_business_impact", """WITH s AS (SELECT win, service, max(score) AS score FROM v_daily WHERE metric LIKE 'request.%' GROUP BY 1,2), e AS (SELECT win, src, dst FROM (SELECT DISTINCT win FROM s) CROSS JOIN v_graph WHERE edge_type='call')
 SELECT impact, count(*) AS n FROM (SELECT CASE WHEN greatest(coalesce(a.score,0), coalesce(b.score,0))>2 THEN 'business' ELSE 'isolated_edge' END AS impact FROM e LEFT JOIN s a ON a.win=e.win AND a.service=src LEFT JOIN s b ON b.win=e.win AND b.service=dst) GROUP BY 1""")
def _(v):
    s = daily(v).where("metric like 'request.%'").groupBy(F.col("win").alias("window"), "service").agg(F.max("score").alias("score"))
    calls = F.broadcast(v.graph().where("edge_type = 'call'").select("src", "dst"))  # the ring of eleven services
    return A.business_impact(s.select("window").distinct().join(calls), s, 2.0).groupBy("impact").agg(F.count("*").alias("n"))


SQL["v_scores"] = "SELECT service, win, max(score) AS score FROM v_daily GROUP BY 1,2"
SQL["v_states"] = """WITH RECURSIVE o AS (SELECT service, win, score, row_number() OVER (PARTITION BY service ORDER BY win) AS r FROM v_scores),
 f AS (SELECT service, r, win, score, CASE WHEN score>=1.5 THEN 1 ELSE 0 END AS s, CASE WHEN score>=3 THEN 1 ELSE 0 END AS h, CASE WHEN score<1.5 THEN 1 ELSE 0 END AS calm,
   CASE WHEN score>=3 AND 1>=2 THEN 'hard' ELSE 'healthy' END AS state FROM o WHERE r=1
  UNION ALL SELECT o.service, o.r, o.win, o.score, CASE WHEN o.score>=1.5 THEN f.s+1 ELSE 0 END, CASE WHEN o.score>=3 THEN f.h+1 ELSE 0 END, CASE WHEN o.score<1.5 THEN f.calm+1 ELSE 0 END,
   CASE WHEN o.score>=3 AND f.h+1>=2 THEN 'hard' WHEN f.state='hard' THEN CASE WHEN o.score<1.5 AND f.calm+1>=2 THEN 'recovery' ELSE 'hard' END
    WHEN f.state='recovery' THEN CASE WHEN o.score<1.5 AND f.calm+1>=3 THEN 'healthy' ELSE 'recovery' END WHEN o.score>=1.5 AND f.s+1>=2 THEN 'soft'
    WHEN f.state='soft' THEN CASE WHEN o.score<1.5 THEN 'healthy' ELSE 'soft' END ELSE 'healthy' END
  FROM f JOIN o ON o.service=f.service AND o.r=f.r+1) SELECT service, win, score, state FROM f"""


def states(v):
    w = daily(v).groupBy("service", "win").agg(F.max("score").alias("score"))
    return A.state_machine(w, "service", "win", 1.5, 3.0, 2, 2, 2, 1).select("service", F.col("at").cast("long").alias("win"), "score", "state")


@query("alr_04_state_machine", SQL["v_states"])
def _(v):
    return states(v)


_CHG = "SELECT *, coalesce(lag(state) OVER (PARTITION BY service ORDER BY win), 'healthy') AS previous FROM st"
_ST = SQL["v_states"].replace(") SELECT service, win, score, state FROM f", "), st AS (SELECT service, win, score, state FROM f)")


@query("alr_05_alert_events", f"{_ST} SELECT service, win, previous, state, sha256(service||'|'||win||'|'||state) AS alert_id FROM ({_CHG}) WHERE state<>previous")
def _(v):
    return A.state_changes(states(v), "service", "win").select("service", "win", "previous", "state", "alert_id")


@query("alr_06_update_gate", f"{_ST} SELECT state='healthy' AS baseline_may_learn, state IN ('healthy','recovery') AS model_may_learn, state IN ('soft','hard') AS frozen, count(*) AS n FROM st GROUP BY 1,2,3")
def _(v):
    return A.update_gate(states(v)).groupBy("baseline_may_learn", "model_may_learn", "frozen").agg(F.count("*").alias("n"))


@query("alr_07_detect", "SELECT event_id, severity, alert_score, array_to_string(reasons, ';') AS reason, array_to_string(resources, ';') AS resources FROM v_events")
def _(v):
    return events(v).select("event_id", "severity", "alert_score", F.concat_ws(";", "reasons").alias("reason"), F.when(F.col("resources").isNotNull(), F.concat_ws(";", "resources")).alias("resources"))


@query("alr_08_typical_step", "SELECT greatest(5.0, median(gap)*1.5) AS step FROM (SELECT timestamp - lag(timestamp) OVER (PARTITION BY service, metric ORDER BY timestamp) AS gap FROM v_metrics) WHERE gap>0")
def _(v):
    return A.typical_step(v.metrics(), ["service", "metric"], "timestamp")


@query("alr_09_alert_windows", "SELECT * FROM v_windows")
def _(v):
    w = windows(v)
    return w.select("window_no", "start_ts", "end_ts", "max_z", "event_count", "severity", F.concat_ws(",", "trigger_metrics").alias("triggers"))


@query("alr_10_symptom_vote", "SELECT window_no, service AS symptom_service, votes FROM (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY votes DESC, z DESC, sc DESC, service) AS r FROM (SELECT window_no, service, count(*) AS votes, max(z_score) AS z, max(alert_score) AS sc FROM v_numbered GROUP BY 1,2)) WHERE r=1")
def _(v):
    return A.symptom_vote(numbered(v))


@query("alr_11_overlap_check", "SELECT incident_id, count(window_no) AS windows, count(window_no)>0 AS covered FROM v_incidents i LEFT JOIN v_windows w ON w.start_ts<=i.end_ts AND i.start_ts<=w.end_ts GROUP BY 1")
def _(v):
    return A.overlap_check(windows(v), v.incidents())


@query("alr_12_control_transitions", f"{_ST} SELECT service, previous, state, count(*) AS n, min(win) AS first_win FROM ({_CHG}) WHERE state<>previous GROUP BY 1,2,3")
def _(v):
    return A.state_changes(states(v), "service", "win").groupBy("service", "previous", "state").agg(F.count("*").alias("n"), F.min("win").alias("first_win"))


_CAL = """g AS (SELECT service, win, score, CAST(sum(CASE WHEN win%40=0 THEN 1 ELSE 0 END) OVER (PARTITION BY service ORDER BY win) AS BIGINT) AS segment FROM v_scores),
 i AS (SELECT *, sum(CASE WHEN score<2 THEN 0 ELSE 1 END) OVER (PARTITION BY service, segment ORDER BY win) AS isl FROM g), k AS (SELECT *, CAST(sum(CASE WHEN score<2 THEN 1 ELSE 0 END) OVER (PARTITION BY service, segment, isl ORDER BY win) AS BIGINT) AS streak FROM i),
 cal AS (SELECT service, win, segment, streak, CASE WHEN max(streak) OVER (PARTITION BY service, segment ORDER BY win)>=4 THEN 'ready' WHEN streak>0 THEN 'calibrating' ELSE 'starting' END AS stage FROM k)"""


def _calibrated(v):
    w = daily(v).groupBy("service", "win").agg(F.max("score").alias("score"))
    return A.calibration(w, "service", "win", F.col("win") % 40 == 0, F.col("score") < 2, 4)


@query("alr_13_calibration", f"WITH {_CAL} SELECT * FROM cal")
def _(v):
    return _calibrated(v).select("service", "win", "segment", "streak", "stage")


@query("alr_14_readiness_report", f"WITH {_CAL} SELECT service, bool_and(stage='ready') AS ready, count(*) AS windows, count(*) FILTER (stage='ready') AS ready_windows FROM cal GROUP BY 1")
def _(v):
    return _calibrated(v).groupBy("service").agg(F.bool_and(F.col("stage") == "ready").alias("ready"), F.count("*").alias("windows"), F.count(F.when(F.col("stage") == "ready", 1)).alias("ready_windows"))
