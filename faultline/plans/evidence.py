"""Queries for observation policy, evidence and inversion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators import evidence as E
from faultline.operators import inversion as I
from faultline.operators.tables import written

from .alerts import daily, windows
from .baselines import scored
from .views import SQL, query

SQL["v_alertz"] = "SELECT service, win, max(abs(score)) AS alert_z FROM v_daily WHERE metric LIKE 'request.%' GROUP BY 1,2"
SQL["v_astreak"] = "SELECT *, CAST(sum(CASE WHEN alert_z>=3 THEN 1 ELSE 0 END) OVER (PARTITION BY service, isl ORDER BY win) AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN alert_z>=3 THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY win) AS isl FROM v_alertz)"
SQL["v_modes"] = """SELECT event_id, m.service, metric, mode, CASE mode WHEN 'always_on' THEN 1.0 WHEN 'hard_alert_burst' THEN 1.0 WHEN 'soft_alert_burst' THEN 0.4 ELSE 0.1 END AS probability FROM (
 SELECT m.*, CASE WHEN metric LIKE 'request.%' THEN 'always_on' WHEN coalesce(streak,0)>=2 THEN 'hard_alert_burst' WHEN coalesce(alert_z,0)>=2 THEN 'soft_alert_burst' ELSE 'normal_sampled' END AS mode FROM (SELECT *, CAST(floor(timestamp/21600) AS BIGINT) AS win FROM v_metrics) m LEFT JOIN v_astreak a ON a.service=m.service AND a.win=m.win) m"""
SQL["v_drawn"] = "SELECT *, ('0x'||substr(md5(event_id||'#7'),1,8))::BIGINT/4294967296.0 < probability AS observed FROM v_modes"


def modes(v):
    alert = daily(v).where("metric like 'request.%'").groupBy("service", F.col("win").alias("window")).agg(F.max(F.abs("score")).alias("alert_z"))
    rows = v.metrics().withColumn("window", F.floor(F.col("timestamp") / 21600))
    return E.observation_mode(rows, alert, soft=2.0, hard=3.0)


def drawn(v):
    return E.sampled(modes(v), "event_id")


@query("obs_01_observation_mode", "SELECT event_id, mode, probability FROM v_modes")
def _(v):
    return modes(v).select("event_id", "mode", "probability")


@query("obs_02_sampled_rows", "SELECT event_id, observed FROM v_drawn")
def _(v):
    return drawn(v).select("event_id", "observed")


SQL["v_gain"] = "SELECT service, metric, cost, 0.3*severity+0.2*intensity+0.2*evidence+0.15*centrality+0.15*missing-0.1*cost AS gain FROM (SELECT service, metric, least(max(value)/500,1) AS severity, avg(value)/500 AS intensity, least(count(*)/300.0,1) AS evidence, 0.5 AS centrality, 0.25 AS missing, CASE WHEN metric LIKE 'request.%' THEN 1.0 WHEN metric LIKE 'cpu.%' THEN 2.0 ELSE 3.0 END AS cost FROM v_metrics GROUP BY 1,2)"


def gains(v):
    cost = F.when(F.col("metric").startswith("request."), 1.0).when(F.col("metric").startswith("cpu."), 2.0).otherwise(3.0)
    t = v.metrics().groupBy("service", "metric").agg(F.least(F.max("value") / 500, F.lit(1.0)).alias("severity"), (F.avg("value") / 500).alias("intensity"), F.least(F.count("*") / 300.0, F.lit(1.0)).alias("evidence"))
    return E.probe_gain(t.withColumns({"centrality": F.lit(0.5), "missing": F.lit(0.25), "cost": cost}))


@query("obs_03_probe_gain", "SELECT service, metric, gain, 1/(1+exp(-4*gain)) AS probability FROM v_gain")
def _(v):
    return gains(v).select("service", "metric", "gain", "probability")


def plan(v):
    return E.within_budget(gains(v).withColumn("probe", F.col("metric")), "service", 6.0)


SQL["v_plan"] = """WITH RECURSIVE o AS (SELECT service, metric, cost, row_number() OVER (PARTITION BY service ORDER BY -gain/cost, metric) AS r FROM v_gain),
 f AS (SELECT service, 0 AS r, 0.0::DOUBLE AS spent, NULL::VARCHAR AS probe FROM (SELECT DISTINCT service FROM v_gain) UNION ALL SELECT f.service, o.r, CASE WHEN spent+cost<=6 THEN spent+cost ELSE spent END, CASE WHEN spent+cost<=6 THEN metric END FROM f JOIN o ON o.service=f.service AND o.r=f.r+1)
 SELECT service, max(spent) OVER (PARTITION BY service) AS spent, probe FROM f"""


@query("obs_04_budget_choice", f"SELECT * FROM ({SQL['v_plan']}) WHERE probe IS NOT NULL")
def _(v):
    return plan(v)


@query("obs_05_probe_plan", f"SELECT p.service, probe, spent, gain, 1/(1+exp(-4*gain)) AS probability FROM ({SQL['v_plan']}) p JOIN v_gain g ON g.service=p.service AND g.metric=probe")
def _(v):
    return plan(v).join(gains(v).select("service", F.col("metric").alias("probe"), "gain", "probability"), ["service", "probe"])


@query("obs_06_probability_lookup", "SELECT service, metric, max(probability) AS probability FROM v_modes GROUP BY 1,2")
def _(v):
    return modes(v).groupBy("service", "metric").agg(F.max("probability").alias("probability"))


@query("obs_07_observation_audit", "SELECT avg(r) AS mean_ratio, min(r) AS min_ratio, max(r) AS max_ratio, min(r)>0.2 AND max(r)<0.9 AS inside FROM (SELECT service, avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) AS r FROM v_drawn GROUP BY 1)")
def _(v):
    r = drawn(v).groupBy("service").agg(F.avg(F.col("observed").cast("double")).alias("r"))
    return r.agg(F.avg("r").alias("mean_ratio"), F.min("r").alias("min_ratio"), F.max("r").alias("max_ratio"), ((F.min("r") > 0.2) & (F.max("r") < 0.9)).alias("inside"))


# --- evidence

SQL["v_blind"] = """SELECT *, a-b AS absolute_lift, (a-b)/(abs(b)+1e-9) AS relative_lift FROM (SELECT v_incidents.incident_id, service, metric, avg(value) FILTER (timestamp<start_ts) AS b, avg(value) FILTER (timestamp>=start_ts) AS a,
 CASE metric WHEN 'cpu.throttled_usec' THEN 'CPU' WHEN 'net.retrans' THEN 'network' WHEN 'io.write_bytes' THEN 'storage I/O' ELSE 'load' END AS evidence_type FROM v_metrics JOIN v_incidents ON timestamp<=end_ts GROUP BY 1,2,3) WHERE a IS NOT NULL AND b IS NOT NULL"""
SQL["v_normal"] = "SELECT *, absolute_lift/max(absolute_lift) OVER (PARTITION BY incident_id, evidence_type) AS evidence_score FROM v_blind WHERE absolute_lift>0"
SQL["v_evidence"] = "SELECT incident_id, service, metric, evidence_type, evidence_score AS value, absolute_lift FROM v_normal"


def blind(v):
    return E.blind_lift(v.metrics(), v.incidents(), "incident_id")


def evidence(v):
    return E.normalised_evidence(blind(v), "incident_id").withColumn("value", F.col("evidence_score"))


@query("evd_01_blind_lift", "SELECT incident_id, service, metric, absolute_lift, relative_lift FROM v_blind")
def _(v):
    return blind(v).select("incident_id", "service", "metric", "absolute_lift", "relative_lift")


@query("evd_02_alert_window_lift", "SELECT window_no, service, metric, avg(value) FILTER (timestamp>=start_ts)-avg(value) FILTER (timestamp<start_ts) AS absolute_lift FROM v_metrics JOIN v_windows ON timestamp<=end_ts GROUP BY 1,2,3 HAVING count(*) FILTER (timestamp>=start_ts)>0 AND count(*) FILTER (timestamp<start_ts)>0")
def _(v):
    return E.separate_lift(v.metrics(), written(windows(v)), "window_no").select("window_no", "service", "metric", "absolute_lift")


@query("evd_03_normalised_lift", "SELECT incident_id, service, metric, evidence_score FROM v_normal")
def _(v):
    return evidence(v).select("incident_id", "service", "metric", "evidence_score")


_TOP = "SELECT incident_id, evidence_type, service, metric, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, evidence_type ORDER BY evidence_score DESC, absolute_lift DESC, service, metric) AS rank FROM v_normal WHERE evidence_score>=0.3) WHERE rank<=3"


@query("evd_04_top_per_type", _TOP)
def _(v):
    return E.top_per_type(evidence(v), "incident_id", 0.3, 3).select("incident_id", "evidence_type", "service", "metric", "rank")


@query("evd_05_blind_evidence", f"SELECT incident_id, evidence_type, count(*) AS n, array_to_string(list_sort(list(service||'.'||metric)), ',') AS nodes FROM ({_TOP}) GROUP BY 1,2")
def _(v):
    t = E.top_per_type(evidence(v), "incident_id", 0.3, 3)
    return t.groupBy("incident_id", "evidence_type").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(".", "service", "metric")))).alias("nodes"))


_ET = "CASE metric WHEN 'cpu.throttled_usec' THEN 'CPU' WHEN 'net.retrans' THEN 'Net' WHEN 'io.write_bytes' THEN 'IO' ELSE 'Load' END"
SQL["v_kind"] = f"SELECT incident_id, service, {_ET} AS et, avg(abs(value)) AS by_type FROM v_evidence GROUP BY 1,2,3"


@query("evd_06_evidence_strength", f"SELECT incident_id, service, {_ET.replace('metric', 'e.metric', 1)} AS evidence_type, avg(abs(value)) AS by_type, array_to_string(list_sort(list(DISTINCT metric)), ',') AS support FROM v_evidence e GROUP BY 1,2,3")
def _(v):
    return E.evidence_strength(evidence(v).drop("evidence_type"))[1].withColumn("support", F.concat_ws(",", "support"))


SQL["v_sparse"] = """SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY intervention_score DESC, service, metric) AS rank FROM (SELECT incident_id, service, metric, residual_lift, least(100.0, raw*greatest(0, 1-0.05/(sqrt(sum(raw*raw) OVER (PARTITION BY incident_id, service))+1e-12))) AS intervention_score FROM (
 SELECT *, greatest(residual_lift-0.05,0)*CASE metric WHEN 'cpu.throttled_usec' THEN 4.0 WHEN 'net.retrans' THEN 2.0 WHEN 'io.write_bytes' THEN 1.0 ELSE 0.25 END AS raw FROM (SELECT incident_id, service, metric, greatest(0, coalesce(avg(abs(residual)) FILTER (timestamp>=start_ts),0)-coalesce(avg(abs(residual)) FILTER (timestamp<start_ts),0)) AS residual_lift FROM v_residuals GROUP BY 1,2,3)))"""
SQL["v_ipw"] = """SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY intervention_score DESC, residual_lift DESC, confidence DESC, service, metric) AS rank FROM (SELECT incident_id, service, metric, residual_lift, greatest(residual_lift-0.05,0)*CASE WHEN nb<2 OR nf<2 THEN 0.75 ELSE 1.0 END AS intervention_score, least(1.0, least(nb,nf)/3.0) AS confidence FROM (
 SELECT incident_id, service, metric, greatest(0, coalesce(sum(w*abs(residual)) FILTER (f)/sum(w) FILTER (f),0)-coalesce(sum(w*abs(residual)) FILTER (NOT f)/sum(w) FILTER (NOT f),0)) AS residual_lift, count(*) FILTER (NOT f) AS nb, count(*) FILTER (f) AS nf FROM (SELECT *, timestamp>=start_ts AS f, least(20.0, 1/greatest(probability,0.05)) AS w FROM v_residuals) GROUP BY 1,2,3))"""
SQL["v_sem"] = f"""SELECT incident_id, service, metric, et, evidence_score, semantic_score, intervention_score, row_number() OVER (PARTITION BY incident_id ORDER BY semantic_score DESC, service, metric) AS semantic_rank FROM (
 SELECT *, greatest(0, least(500, (CASE WHEN intervention_score=0 AND evidence_score>0 THEN evidence_score ELSE intervention_score*(1+3*evidence_score) END + 1.5*evidence_score*max(intervention_score) OVER (PARTITION BY incident_id)) * CASE metric WHEN 'cpu.throttled_usec' THEN 2.2 WHEN 'net.retrans' THEN 2.2 WHEN 'request.p99_latency_ms' THEN 0.6 WHEN 'request.error_rate' THEN 0.75 ELSE 1.0 END)) AS semantic_score FROM (
 SELECT *, CASE WHEN max(raw) OVER (PARTITION BY incident_id)>0 THEN raw/(max(raw) OVER (PARTITION BY incident_id)+1e-12) ELSE 0.0 END AS evidence_score FROM (
 SELECT s.incident_id, s.service, s.metric, s.intervention_score, {_ET.replace('metric', 's.metric', 1)} AS et, 2*coalesce(x.exact,0)+1*coalesce(k.by_type,0)+0.5*coalesce(b.by_service,0) AS raw FROM v_sparse s
 LEFT JOIN (SELECT incident_id, service, metric, avg(abs(value)) AS exact FROM v_evidence GROUP BY 1,2,3) x ON x.incident_id=s.incident_id AND x.service=s.service AND x.metric=s.metric
 LEFT JOIN v_kind k ON k.incident_id=s.incident_id AND k.service=s.service AND k.et={_ET.replace('metric', 's.metric', 1)}
 LEFT JOIN (SELECT incident_id, service, max(by_type) AS by_service FROM v_kind GROUP BY 1,2) b ON b.incident_id=s.incident_id AND b.service=s.service)))"""
SQL["v_types"] = "SELECT incident_id, root_type, sum(semantic_score) AS type_score FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, root_type ORDER BY semantic_score DESC, service, metric) AS r FROM (SELECT *, CASE et WHEN 'Net' THEN 'network' WHEN 'IO' THEN 'storage I/O' WHEN 'Load' THEN 'load' ELSE et END AS root_type FROM v_sem)) WHERE r<=10 GROUP BY 1,2"


def sparse(v):
    return v.kept("sparse", lambda: I.sparse_scores(v.residuals(), l1=0.05, group=0.05))


def ipw(v):
    return I.ipw_sparse_scores(v.residuals(), l1=0.05)


def semantic(v):
    return v.kept("semantic", lambda: E.semantic_scores(sparse(v), evidence(v).drop("evidence_type")))


@query("evd_07_semantic_scores", "SELECT incident_id, service, metric, evidence_score, semantic_score, semantic_rank FROM v_sem")
def _(v):
    return semantic(v).select("incident_id", "service", "metric", "evidence_score", "semantic_score", "semantic_rank")


@query("evd_08_type_scores", "SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY type_score DESC, root_type) AS rank FROM v_types")
def _(v):
    return E.type_scores(semantic(v))


@query("evd_09_evidence_index", "SELECT incident_id, service, et AS evidence_type, by_type/max(by_type) OVER (PARTITION BY incident_id) AS share FROM v_kind")
def _(v):
    k = E.evidence_strength(evidence(v).drop("evidence_type"))[1]
    return k.select("incident_id", "service", "evidence_type", S.max_normalised(F.col("by_type"), Window.partitionBy("incident_id")).alias("share"))


@query("evd_10_ipw_semantic", """SELECT incident_id, service, metric, s AS semantic_score, row_number() OVER (PARTITION BY incident_id ORDER BY s DESC, service, metric) AS rank FROM (SELECT i.*, (intervention_score*(1+3*coalesce(k.share,0)) + CASE WHEN intervention_score>=q THEN 0.5*coalesce(k.share,0) ELSE 0 END)*CASE WHEN confidence<1 THEN 0.85 ELSE 1.0 END AS s FROM (SELECT *, quantile_cont(intervention_score, 0.75) OVER (PARTITION BY incident_id) AS q FROM v_ipw) i
 LEFT JOIN (SELECT incident_id, service, et, by_type/max(by_type) OVER (PARTITION BY incident_id) AS share FROM v_kind) k ON k.incident_id=i.incident_id AND k.service=i.service AND k.et="""+_ET.replace('metric', 'i.metric', 1)+")")
def _(v):
    k = E.evidence_strength(evidence(v).drop("evidence_type"))[1]
    k = k.select("incident_id", "service", "evidence_type", S.max_normalised(F.col("by_type"), Window.partitionBy("incident_id")).alias("share"))
    c = ipw(v).withColumn("evidence_type", S.evidence_type(F.col("metric"))).join(k, ["incident_id", "service", "evidence_type"], "left").fillna({"share": 0.0})
    q = ipw(v).groupBy("incident_id").agg(F.percentile("intervention_score", 0.75).alias("q"))
    s = (F.col("intervention_score") * (1 + 3 * F.col("share")) + F.when(F.col("intervention_score") >= F.col("q"), 0.5 * F.col("share")).otherwise(0.0)) * F.when(F.col("confidence") < 1, 0.85).otherwise(1.0)
    c = c.join(q, "incident_id").withColumn("semantic_score", s)
    return c.select("incident_id", "service", "metric", "semantic_score", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("semantic_score"), "service", "metric")).alias("rank"))


@query("evd_11_best_per_type", "SELECT incident_id, et AS evidence_type, service, metric, semantic_score FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, et ORDER BY semantic_score DESC, service, metric) AS r FROM v_sem) WHERE r=1")
def _(v):
    w = Window.partitionBy("incident_id", "evidence_type").orderBy(F.desc("semantic_score"), "service", "metric")
    return semantic(v).withColumn("r", F.row_number().over(w)).where("r = 1").select("incident_id", "evidence_type", "service", "metric", "semantic_score")


SQL["v_vector"] = "SELECT e.incident_id, e.service, e.metric, least(5.0, 0.5*value + 0.3*avg(value) OVER (PARTITION BY incident_id, service, evidence_type) + 0.2*avg(value) OVER (PARTITION BY incident_id, evidence_type)) AS vector FROM v_evidence e"


def vector(v):
    w = lambda *k: F.avg("value").over(Window.partitionBy("incident_id", *k))
    return evidence(v).withColumn("vector", F.least(F.lit(5.0), 0.5 * F.col("value") + 0.3 * w("service", "evidence_type") + 0.2 * w("evidence_type")))


@query("evd_12_evidence_vector", "SELECT * FROM v_vector")
def _(v):
    return vector(v).select("incident_id", "service", "metric", "vector")


@query("evd_13_evidence_effect", "SELECT r.incident_id, event_id, sign(residual)*least(abs(residual), vector*CASE WHEN r.metric LIKE 'request.%' THEN 0.5 ELSE 1.0 END) AS effect FROM v_residuals r JOIN v_vector e ON e.incident_id=r.incident_id AND e.service=r.service AND e.metric=r.metric")
def _(v):
    j = v.residuals().join(vector(v).select("incident_id", "service", "metric", "vector"), ["incident_id", "service", "metric"])
    damp = F.when(F.col("metric").startswith("request."), 0.5).otherwise(1.0)
    return j.select("incident_id", "event_id", (F.signum("residual") * F.least(F.abs("residual"), F.col("vector") * damp)).alias("effect"))


SQL["v_cal"] = """SELECT r.*, greatest(-10, least(10, (residual-m)/(1.4826*d+1e-6))) AS calibrated FROM (SELECT *, CASE WHEN metric LIKE 'request.%' THEN 'load' WHEN metric LIKE 'cpu.%' THEN 'CPU' WHEN metric LIKE 'net.%' THEN 'network' ELSE 'storage I/O' END AS family FROM v_residuals) r JOIN (
 SELECT incident_id, family, m, median(abs(residual-m)) AS d FROM (SELECT *, median(residual) OVER (PARTITION BY incident_id, family) AS m FROM (SELECT *, CASE WHEN metric LIKE 'request.%' THEN 'load' WHEN metric LIKE 'cpu.%' THEN 'CPU' WHEN metric LIKE 'net.%' THEN 'network' ELSE 'storage I/O' END AS family FROM v_residuals)) GROUP BY 1,2,3) s USING (incident_id, family)"""


def calibrated(v):
    return v.kept("calibrated", lambda: E.calibrate(v.residuals().withColumn("family", S.metric_family(F.col("metric")))))


@query("evd_14_calibrated_residuals", "SELECT incident_id, event_id, calibrated FROM v_cal")
def _(v):
    return calibrated(v).select("incident_id", "event_id", "calibrated")


@query("evd_15_evidence_channel", "SELECT c.incident_id, c.service, c.metric, avg(calibrated) AS residual, max(vector) AS vector, count(*) AS n FROM v_cal c LEFT JOIN v_vector e ON e.incident_id=c.incident_id AND e.service=c.service AND e.metric=c.metric GROUP BY 1,2,3")
def _(v):
    j = calibrated(v).join(vector(v).select("incident_id", "service", "metric", "vector"), ["incident_id", "service", "metric"], "left")
    return j.groupBy("incident_id", "service", "metric").agg(F.avg("calibrated").alias("residual"), F.max("vector").alias("vector"), F.count("*").alias("n"))


SQL["v_burst"] = "SELECT service, CAST(floor(timestamp/86400) AS BIGINT) AS win, metric AS channel, least(count(*)/21.0,1.0) AS strength, avg(value)/500 AS quality FROM v_metrics GROUP BY 1,2,3"


def burst(v):
    return v.metrics().groupBy("service", F.floor(F.col("timestamp") / 86400).alias("win"), F.col("metric").alias("channel")).agg(F.least(F.count("*") / 21.0, F.lit(1.0)).alias("strength"), (F.avg("value") / 500).alias("quality"))


@query("evd_16_burst_evidence", "SELECT * FROM v_burst")
def _(v):
    return burst(v)


@query("evd_17_group_strength", "SELECT service, win, 1-product(1-strength) AS strength, count(*) AS channels FROM v_burst GROUP BY 1,2")
def _(v):
    return E.group_strength(burst(v), ["service", "win"])


@query("evd_18_canonical_evidence", "SELECT service, day, count(*) AS copies, count(DISTINCT metric)>1 AS conflict FROM (SELECT service, CAST(floor(timestamp/86400) AS BIGINT) AS day, metric FROM v_metrics) GROUP BY 1,2")
def _(v):
    rows = v.metrics().select("service", F.floor(F.col("timestamp") / 86400).alias("day"), "metric")
    return E.deduplicated(rows, ["service", "day"], ["metric"]).select("service", "day", "copies", "conflict")


@query("evd_19_usable_evidence", "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN timestamp>1706400000 THEN 'after_cutoff' WHEN value/500<0.1 THEN 'low_quality' WHEN node='node1' THEN 'circular' ELSE 'accepted' END AS decision FROM v_metrics) GROUP BY 1")
def _(v):
    rows = v.metrics().withColumns({"quality": F.col("value") / 500, "sources": F.array("node"), "residual_sources": F.array(F.lit("node1"))})
    return E.usable(rows, F.lit(1706400000.0), 0.1).groupBy("decision").agg(F.count("*").alias("n"))


@query("evd_21_identity_mapping", "SELECT status, count(*) AS n FROM (SELECT event_id, CASE count(i.service) WHEN 0 THEN 'unmapped' WHEN 1 THEN 'mapped' ELSE 'reused' END AS status FROM v_metrics m LEFT JOIN v_intervals i ON i.cgroup=m.instance AND m.timestamp>=i.valid_from AND m.timestamp<i.valid_to GROUP BY 1) GROUP BY 1")
def _(v):
    e = v.metrics().select("event_id", "timestamp", F.col("instance").alias("cgroup"))
    return E.mapped_events(e, v.intervals()).groupBy("status").agg(F.count("*").alias("n"))


@query("evd_22_mapped_rows", "SELECT kind, service, count(*) AS n, sum(value) AS total FROM (SELECT 'metric' AS kind, service, value FROM v_metrics UNION ALL SELECT 'burst', service, value/1000 FROM v_metrics WHERE metric='cpu.throttled_usec') GROUP BY 1,2")
def _(v):
    m = v.metrics()
    both = m.select(F.lit("metric").alias("kind"), "service", "value").unionByName(m.where("metric = 'cpu.throttled_usec'").select(F.lit("burst").alias("kind"), "service", (F.col("value") / 1000).alias("value")))
    return both.groupBy("kind", "service").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("evd_23_event_loss", "SELECT service, count(*) AS seen, CAST(sum(gap) AS BIGINT) AS lost, sum(gap)/(count(*)+sum(gap)) AS loss_rate FROM (SELECT service, coalesce(greatest(event_id - lag(event_id) OVER (PARTITION BY service ORDER BY event_id) - 1, 0),0) AS gap FROM v_metrics) GROUP BY 1")
def _(v):
    return E.sequence_loss(v.metrics(), "service", "event_id")


@query("evd_24_candidate_filter", "SELECT service, count(*) AS accepted FROM v_metrics WHERE service IN (SELECT root_service FROM v_incidents) GROUP BY 1")
def _(v):
    roots = v.incidents().select(F.col("root_service").alias("service"))
    return v.metrics().join(roots, "service", "left_semi").groupBy("service").agg(F.count("*").alias("accepted"))


@query("evd_25_channel_samples", "SELECT service, win, metric AS channel, quantile_disc(value,0.95) AS p95, count(*)*10 AS exposure FROM (SELECT *, CAST(floor(timestamp/21600) AS BIGINT) AS win FROM v_metrics) GROUP BY 1,2,3")
def _(v):
    t = v.metrics().groupBy("service", F.floor(F.col("timestamp") / 21600).alias("win"), F.col("metric").alias("channel"))
    return t.agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), (F.count("*") * 10).alias("exposure"))


@query("evd_26_checkpoint_loss", """WITH w AS (SELECT incident_id, root_service AS service, start_ts, end_ts FROM v_incidents), k AS (SELECT service, timestamp, value FROM v_metrics WHERE metric='net.retrans')
 SELECT incident_id, (SELECT arg_min(value, (timestamp, value)) FROM k WHERE k.service=w.service AND timestamp>=end_ts)-(SELECT arg_max(value, (timestamp, value)) FROM k WHERE k.service=w.service AND timestamp<=start_ts) AS difference, CAST(EXISTS (SELECT 1 FROM k WHERE k.service=w.service AND timestamp>=end_ts) AND EXISTS (SELECT 1 FROM k WHERE k.service=w.service AND timestamp<=start_ts) AS INT) AS coverage FROM w""")
def _(v):
    w = v.incidents().select("incident_id", F.col("root_service").alias("service"), "start_ts", "end_ts")
    return E.nearest_checkpoints(w, v.metrics().where("metric = 'net.retrans'"), "service").select("incident_id", "difference", "coverage")


# --- inversion

@query("inv_01_sparse_scores", "SELECT incident_id, service, metric, residual_lift, intervention_score, rank FROM v_sparse")
def _(v):
    return sparse(v).select("incident_id", "service", "metric", "residual_lift", "intervention_score", "rank")


@query("inv_02_ipw_sparse", "SELECT incident_id, service, metric, residual_lift, intervention_score, confidence, rank FROM v_ipw")
def _(v):
    return ipw(v).select("incident_id", "service", "metric", "residual_lift", "intervention_score", "confidence", "rank")


SQL["v_signal"] = "SELECT incident_id, service, metric, family, service||'.'||metric AS node_id, least(10.0, coalesce(sum(calibrated) FILTER (r<=k)/max(k),0)*CASE WHEN family='load' THEN 0.6 ELSE 1.0 END) AS signal FROM (SELECT *, CASE WHEN calibrated>0 THEN row_number() OVER (PARTITION BY incident_id, service, metric ORDER BY calibrated DESC) END AS r, greatest(1, ceil(count(*) FILTER (calibrated>0) OVER (PARTITION BY incident_id, service, metric)*0.2)) AS k FROM v_cal) GROUP BY 1,2,3,4,5"


def signal(v):
    return v.kept("signal", lambda: I.residual_signal(calibrated(v)).withColumn("node_id", F.concat_ws(".", "service", "metric")))


def edges(v):
    return v.kept("edges", lambda: I.metric_edges(signal(v), v.graph().where("edge_type = 'call'").select("src", "dst")))


def solution(v):
    s = signal(v)
    return v.kept("solution", lambda: I.graph_inversion(s, edges(v), I.penalties(s)))


@query("inv_03_residual_signal", "SELECT incident_id, service, metric, signal FROM v_signal")
def _(v):
    return signal(v).select("incident_id", "service", "metric", "signal")


@query("inv_04_metric_edges", "SELECT incident_id, a, b, max(weight) AS weight FROM (SELECT x.incident_id, x.node_id AS a, y.node_id AS b, 1.0 AS weight FROM v_signal x JOIN v_signal y ON x.incident_id=y.incident_id AND x.service=y.service AND x.node_id<y.node_id UNION ALL SELECT x.incident_id, least(x.node_id,y.node_id), greatest(x.node_id,y.node_id), 0.5 FROM v_signal x JOIN v_graph g ON g.src=x.service AND edge_type='call' JOIN v_signal y ON y.incident_id=x.incident_id AND y.service=g.dst AND y.family=x.family AND x.service<>y.service) GROUP BY 1,2,3")
def _(v):
    return edges(v)


_PEN = "SELECT a.incident_id, greatest(0.15, least(3.0, q)) AS l1, greatest(0.05, least(1.5, gq*0.2)) AS \"group\" FROM (SELECT incident_id, quantile_cont(abs(signal),0.6) AS q FROM v_signal GROUP BY 1) a JOIN (SELECT incident_id, median(norm) AS gq FROM (SELECT incident_id, service, sqrt(sum(signal*signal)) AS norm FROM v_signal GROUP BY 1,2) GROUP BY 1) b USING (incident_id)"


@query("inv_05_penalty_choice", _PEN)
def _(v):
    return I.penalties(signal(v))


@query("inv_06_graph_inversion")
def _(v):
    return solution(v)


@query("inv_07_objective")
def _(v):
    s = signal(v)
    return I.objective(s, solution(v), edges(v), I.penalties(s))


@query("inv_08_post_sparsify", "SELECT incident_id, service, node_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY x DESC, node_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, service ORDER BY x DESC, node_id) AS k FROM (SELECT incident_id, service, node_id, signal AS x, count(*) OVER (PARTITION BY incident_id) AS total FROM v_signal) WHERE x>0) WHERE k<=2) WHERE rank<=greatest(1, ceil(total*0.35))")
def _(v):
    s = signal(v).select("incident_id", "service", "node_id", F.col("signal").alias("x"))
    return I.post_sparsify(s).select("incident_id", "service", "node_id", "rank")


@query("inv_09_rankings", "SELECT incident_id, service, norm, best, row_number() OVER (PARTITION BY incident_id ORDER BY norm DESC, service) AS rank FROM (SELECT incident_id, service, sqrt(sum(signal*signal)) AS norm, max(signal) AS best FROM v_signal GROUP BY 1,2)")
def _(v):
    t = signal(v).groupBy("incident_id", "service").agg(F.sqrt(F.sum(F.col("signal") * F.col("signal"))).alias("norm"), F.max("signal").alias("best"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("norm"), "service")))


def groups(v):
    s = signal(v).groupBy("incident_id", "service").agg(F.transform(F.sort_array(F.collect_list(F.struct("metric", "signal"))), lambda x: x["signal"]).alias("r"))
    b = E.group_strength(burst(v), ["service", "win"]).groupBy("service").agg(F.max("strength").alias("h"))
    return s.join(b, "service").withColumn("q", F.transform("r", lambda _: F.lit(1.0)))


@query("inv_11_group_solve")
def _(v):
    return I.group_solve(groups(v), ["incident_id", "service"]).select("incident_id", "service", "theta")


@query("inv_12_ranked_roots")
def _(v):
    t = I.group_solve(groups(v), ["incident_id", "service"]).withColumn("norm", F.sqrt(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x * x)))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("norm"), "service"))).where("rank <= 5").select("incident_id", "service", "norm", "h", "rank")


@query("inv_20_root_rank", "SELECT i.incident_id, rank AS root_rank, intervention_score FROM v_incidents i JOIN v_sparse s ON s.incident_id=i.incident_id AND s.service=root_service AND s.metric=root_metric")
def _(v):
    i = v.incidents().select("incident_id", F.col("root_service").alias("service"), F.col("root_metric").alias("metric"))
    return i.join(sparse(v), ["incident_id", "service", "metric"]).select("incident_id", F.col("rank").alias("root_rank"), "intervention_score")
