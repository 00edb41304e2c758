"""Queries for diagnosis, explanation, results and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators import diagnosis as D
from faultline.operators import topology as T

from .evidence import calibrated, ipw, semantic, signal, sparse
from .views import SQL, query

SQL["v_adj"] = "SELECT src, dst, max(weight) AS weight FROM v_graph WHERE edge_type='call' GROUP BY 1,2"


def ring(v):
    return v.kept("ring", lambda: v.graph().where("edge_type = 'call'").groupBy("src", "dst").agg(F.max("weight").alias("weight")))


@query("dia_01_candidate_energy", "SELECT incident_id, service, sqrt(sum(probability*residual*residual)) AS energy FROM v_residuals GROUP BY 1,2")
def _(v):
    return D.energy(v.residuals(), ["incident_id", "service"], "probability", "residual")


SQL["v_sig"] = "SELECT incident_id, service, metric, avg(calibrated) AS x FROM v_cal GROUP BY 1,2,3"


def signatures(v):
    return calibrated(v).groupBy("incident_id", "service", "metric").agg(F.avg("calibrated").alias("x"))


@query("dia_05_coherence", "SELECT incident_id, service, max(abs(c)) AS coherence FROM (SELECT a.incident_id, a.service, sum(a.x*b.x)/(max(na.n)*max(nb.n)+1e-12) AS c FROM v_sig a JOIN v_sig b ON a.incident_id=b.incident_id AND a.metric=b.metric AND a.service<>b.service JOIN (SELECT incident_id, service, sqrt(sum(x*x)) AS n FROM v_sig GROUP BY 1,2) na ON na.incident_id=a.incident_id AND na.service=a.service JOIN (SELECT incident_id, service, sqrt(sum(x*x)) AS n FROM v_sig GROUP BY 1,2) nb ON nb.incident_id=b.incident_id AND nb.service=b.service GROUP BY a.incident_id, a.service, b.service) GROUP BY 1,2")
def _(v):
    return D.coherence(signatures(v))


@query("dia_06_entropy", "SELECT incident_id, service, CASE WHEN count(*)>1 THEN -sum(CASE WHEN p>0 THEN p*ln(p) ELSE 0 END)/ln(count(*)) ELSE 0 END AS entropy FROM (SELECT *, abs(x)/sum(abs(x)) OVER (PARTITION BY incident_id, service) AS p FROM v_sig) GROUP BY 1,2")
def _(v):
    return D.entropy(signatures(v), ["incident_id", "service"], "x")


SQL["v_best"] = "SELECT incident_id, service, max(semantic_score) AS score FROM v_sem GROUP BY 1,2"


def best(v):
    return semantic(v).groupBy("incident_id", "service").agg(F.max("semantic_score").alias("score"))


@query("dia_07_margins", "SELECT incident_id, service, score-lead(score) OVER (PARTITION BY incident_id ORDER BY score DESC, service) AS margin FROM v_best")
def _(v):
    return D.margins(best(v))


@query("dia_08_confidence", "SELECT incident_id, service, 1/(1+exp(-(score-mean)/(sd+1e-9))) AS confidence FROM (SELECT *, avg(score) OVER (PARTITION BY incident_id) AS mean, stddev_pop(score) OVER (PARTITION BY incident_id) AS sd FROM v_best)")
def _(v):
    return D.confidence(best(v))


@query("dia_09_final_rank", "SELECT b.incident_id, b.service, score*quality AS final, row_number() OVER (PARTITION BY b.incident_id ORDER BY score*quality DESC, b.service) AS rank FROM v_best b JOIN (SELECT incident_id, service, sum(probability*probability)/sum(probability) AS quality FROM v_residuals GROUP BY 1,2) q ON q.incident_id=b.incident_id AND q.service=b.service")
def _(v):
    q = v.residuals().groupBy("incident_id", "service").agg((F.sum(F.col("probability") * F.col("probability")) / F.sum("probability")).alias("quality"))
    t = best(v).join(q, ["incident_id", "service"]).withColumn("final", F.col("score") * F.col("quality"))
    return t.select("incident_id", "service", "final", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("final"), "service")).alias("rank"))


_GATE = "SELECT incident_id, service, CASE WHEN score<=0 THEN 'none' WHEN margin IS NOT NULL AND margin<0.1*score THEN 'ambiguous' WHEN score>=1 THEN 'strong' ELSE 'weak' END AS choice FROM (SELECT *, score-lead(score) OVER (PARTITION BY incident_id ORDER BY score DESC, service) AS margin, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, service) AS r FROM v_best) WHERE r=1"


@query("dia_10_primary_choice", _GATE)
def _(v):
    return D.primary(best(v))


@query("dia_11_propagated_symptoms", "SELECT s.incident_id, s.service FROM v_best s JOIN v_adj e ON e.src=s.service JOIN v_best t ON t.incident_id=s.incident_id AND t.service=e.dst WHERE t.score*e.weight>=0.5*s.score AND s.score>0 GROUP BY 1,2")
def _(v):
    return D.propagated(best(v), ring(v), 0.5)


_PATHS = "WITH RECURSIVE w AS (SELECT incident_id, root_service AS seed, root_service AS node, [root_service] AS path, 1.0::DOUBLE AS score, symptom_service FROM v_incidents UNION ALL SELECT incident_id, seed, e.dst, list_append(path, e.dst), score*weight*0.9, symptom_service FROM w JOIN v_adj e ON e.src=w.node WHERE len(path)<=10 AND NOT list_contains(path, e.dst))"


def paths(v):
    seeds = v.incidents().select(F.col("root_service").alias("seed")).distinct()
    p = T.simple_paths(seeds, ring(v).withColumn("weight", F.col("weight") * 0.9), 10)
    return v.incidents().join(p, F.col("seed") == F.col("root_service"))


@query("dia_12_propagation_paths", f"{_PATHS} SELECT incident_id, array_to_string(path, '>') AS path, score FROM w WHERE len(path)>1")
def _(v):
    return paths(v).select("incident_id", F.concat_ws(">", "path").alias("path"), "score")


@query("dia_13_evidence_chain", "SELECT incident_id, step, count(*) AS n FROM (SELECT incident_id, 'sparse' AS step FROM v_sparse UNION ALL SELECT incident_id, 'semantic' FROM v_sem WHERE semantic_score>0 UNION ALL SELECT incident_id, 'signal' FROM v_signal WHERE signal>0) GROUP BY 1,2")
def _(v):
    step = lambda d, n: d.select("incident_id", F.lit(n).alias("step"))
    t = step(sparse(v), "sparse").unionByName(step(semantic(v).where("semantic_score > 0"), "semantic")).unionByName(step(signal(v).where("signal > 0"), "signal"))
    return t.groupBy("incident_id", "step").agg(F.count("*").alias("n"))


@query("dia_14_report", "SELECT incident_id, array_to_string(list(service||'.'||metric ORDER BY semantic_rank) FILTER (semantic_rank<=3), ',') AS top, max(semantic_score) AS score FROM v_sem GROUP BY 1")
def _(v):
    top = F.sort_array(F.collect_list(F.when(F.col("semantic_rank") <= 3, F.struct("semantic_rank", F.concat_ws(".", "service", "metric").alias("n")))))
    return semantic(v).groupBy("incident_id").agg(F.concat_ws(",", F.transform(top, lambda x: x["n"])).alias("top"), F.max("semantic_score").alias("score"))


@query("dia_15_path_explanation", f"{_PATHS} SELECT incident_id, array_to_string(path,'>') AS path, score + 0.1/(1+len(path)-1) AS explained, row_number() OVER (PARTITION BY incident_id ORDER BY score + 0.1/(1+len(path)-1) DESC, len(path), array_to_string(path,'>')) AS rank FROM w WHERE node=symptom_service")
def _(v):
    p = paths(v).where("node = symptom_service").withColumn("explained", F.col("score") + 0.1 / F.size("path"))
    text = F.concat_ws(">", "path")
    w = Window.partitionBy("incident_id").orderBy(F.desc("explained"), F.size("path"), text)
    return p.select("incident_id", text.alias("path"), "explained", F.row_number().over(w).alias("rank"))


@query("dia_16_path_fallback", "WITH RECURSIVE d AS (SELECT root_service AS s, root_service AS n, 0 AS h FROM v_incidents UNION SELECT s, dst, h+1 FROM d JOIN v_adj ON src=n WHERE h<4), r AS (SELECT root_service AS s, root_service AS n, 0 AS h FROM v_incidents UNION SELECT s, src, h+1 FROM r JOIN v_adj ON dst=n WHERE h<4) SELECT incident_id, CASE WHEN dh IS NOT NULL THEN 'directed' WHEN rh IS NOT NULL THEN 'reverse' ELSE 'missing' END AS mode, coalesce(dh, rh) AS hops FROM v_incidents i LEFT JOIN (SELECT s, n, min(h) AS dh FROM d GROUP BY 1,2) d ON d.s=root_service AND d.n=symptom_service LEFT JOIN (SELECT s, n, min(h) AS rh FROM r GROUP BY 1,2) r ON r.s=root_service AND r.n=symptom_service")
def _(v):
    return D.path_mode(v.incidents(), ring(v), 4)


SQL["v_result"] = "SELECT incident_id, list(service ORDER BY score DESC, service) AS ranked FROM v_best GROUP BY 1"
SQL["v_mresult"] = "SELECT incident_id, list(service||'.'||metric ORDER BY semantic_rank) AS ranked FROM v_sem GROUP BY 1"


def results(v):
    return D.ranked_list(best(v), "incident_id", [F.desc("score"), F.col("service")], F.col("service"))


def metric_results(v):
    return D.ranked_list(semantic(v), "incident_id", [F.col("semantic_rank")], F.concat_ws(".", "service", "metric"))


@query("dia_17_result_rows", "SELECT incident_id, array_to_string(ranked[1:5], ',') AS top_services FROM v_result")
def _(v):
    return results(v).select("incident_id", F.concat_ws(",", F.slice("ranked", 1, 5)).alias("top_services"))


SQL["v_mtable"] = "SELECT s.incident_id, s.service, s.metric, 0.5*intervention_score/(max(intervention_score) OVER (PARTITION BY s.incident_id)+1e-9) + 0.3*evidence_score + 0.2*signal/(max(signal) OVER (PARTITION BY s.incident_id)+1e-9) AS score FROM v_sem s JOIN v_signal g ON g.incident_id=s.incident_id AND g.service=s.service AND g.metric=s.metric"


def metric_table(v):
    w = Window.partitionBy("incident_id")
    t = semantic(v).join(signal(v).select("incident_id", "service", "metric", "signal"), ["incident_id", "service", "metric"])
    part = lambda c: F.col(c) / (F.max(c).over(w) + 1e-9)
    return t.withColumn("score", 0.5 * part("intervention_score") + 0.3 * F.col("evidence_score") + 0.2 * part("signal")).select("incident_id", "service", "metric", "score")


@query("dia_18_metric_table", "SELECT * FROM v_mtable")
def _(v):
    return metric_table(v)


@query("dia_19_residual_support", "SELECT incident_id, coalesce(service, '*') AS service, coalesce(family, '*') AS family, avg(abs(calibrated)) AS support FROM v_cal GROUP BY GROUPING SETS ((incident_id, service, family), (incident_id, service), (incident_id, family))")
def _(v):
    c = calibrated(v)
    g = lambda *k: c.groupBy("incident_id", *k).agg(F.avg(F.abs("calibrated")).alias("support"))
    star = F.lit("*")
    return g("service", "family").unionByName(g("service").withColumn("family", star)).unionByName(g("family").withColumn("service", star)).select("incident_id", "service", "family", "support")


@query("dia_20_symptom_distance", "WITH RECURSIVE d AS (SELECT DISTINCT src AS s, src AS n, 0 AS h FROM v_adj UNION SELECT s, dst, h+1 FROM d JOIN v_adj ON src=n WHERE h<6) SELECT s AS service, 1/(1+min(h)) AS support FROM d WHERE n='svc0' GROUP BY 1")
def _(v):
    h = T.hops(ring(v).select(F.col("src").alias("seed")).distinct(), ring(v), 6).where("node = 'svc0'")
    return h.select(F.col("seed").alias("service"), (1 / (1 + F.col("hop"))).alias("support"))


SQL["v_stable"] = "SELECT incident_id, service, 0.7*max(score)+0.3*avg(score) AS score FROM v_mtable GROUP BY 1,2"


def service_table(v):
    return metric_table(v).groupBy("incident_id", "service").agg((0.7 * F.max("score") + 0.3 * F.avg("score")).alias("score"))


@query("dia_21_service_table", "SELECT * FROM v_stable")
def _(v):
    return service_table(v)


_ROOT = "SELECT incident_id, service AS root_service, metric AS root_metric FROM (SELECT m.*, row_number() OVER (PARTITION BY m.incident_id ORDER BY m.score DESC, metric) AS r FROM v_mtable m JOIN (SELECT incident_id, service, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, service) AS r FROM v_stable) s ON s.incident_id=m.incident_id AND s.service=m.service AND s.r=1) WHERE r=1"
SQL["v_root"] = _ROOT


def roots(v):
    return D.root_choice(service_table(v), metric_table(v))


@query("dia_22_root_choice", _ROOT)
def _(v):
    return roots(v)


@query("dia_23_integrated_result", "SELECT r.incident_id, root_service, root_metric, score AS confidence FROM v_root r JOIN v_stable s ON s.incident_id=r.incident_id AND s.service=root_service")
def _(v):
    return roots(v).join(service_table(v).withColumnRenamed("service", "root_service"), ["incident_id", "root_service"]).select("incident_id", "root_service", "root_metric", F.col("score").alias("confidence"))


# --- evaluation

_POS = "SELECT i.incident_id, list_position(r.ranked, root_service) AS pos FROM v_incidents i LEFT JOIN v_result r USING (incident_id)"


@query("evl_01_hits", f"SELECT avg(CASE WHEN pos=1 THEN 1.0 ELSE 0.0 END) AS hit1, avg(CASE WHEN pos BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END) AS hit3, avg(CASE WHEN pos>0 THEN 1.0/pos ELSE 0.0 END) AS mrr FROM ({_POS})")
def _(v):
    return D.hits(D.positions(v.incidents(), results(v), F.col("root_service")))


@query("evl_02_type_and_path", "SELECT avg(CASE WHEN t.root_type=i.root_type THEN 1.0 ELSE 0.0 END) AS type_accuracy, avg(CASE WHEN list_has_any(r.ranked[1:3], injected_path) THEN 1.0 ELSE 0.0 END) AS path_fidelity FROM v_incidents i JOIN (SELECT incident_id, root_type FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY type_score DESC, root_type) AS k FROM v_types) WHERE k=1) t USING (incident_id) JOIN v_result r USING (incident_id)")
def _(v):
    from faultline.operators.evidence import type_scores

    t = type_scores(semantic(v)).where("rank = 1").select("incident_id", F.col("root_type").alias("said"))
    j = v.incidents().join(t, "incident_id").join(results(v), "incident_id")
    return j.agg(F.avg((F.col("said") == F.col("root_type")).cast("double")).alias("type_accuracy"), F.avg(F.arrays_overlap(F.slice("ranked", 1, 3), "injected_path").cast("double")).alias("path_fidelity"))


@query("evl_03_report_matching", "SELECT w.window_no, min(i.incident_id) AS incident_id, count(i.incident_id) AS matches FROM v_windows w LEFT JOIN v_incidents i ON w.start_ts<=i.end_ts AND i.start_ts<=w.end_ts GROUP BY 1")
def _(v):
    from .alerts import windows

    j = windows(v).alias("w").join(v.incidents().alias("i"), F.expr("w.start_ts <= i.end_ts and i.start_ts <= w.end_ts"), "left")
    return j.groupBy("w.window_no").agg(F.min("i.incident_id").alias("incident_id"), F.count("i.incident_id").alias("matches"))


_CONF = "SELECT i.root_type AS truth, t.root_type AS said, count(*) AS n FROM v_incidents i JOIN (SELECT incident_id, root_type FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY type_score DESC, root_type) AS k FROM v_types) WHERE k=1) t USING (incident_id) GROUP BY 1,2"


def confusion(v):
    from faultline.operators.evidence import type_scores

    t = type_scores(semantic(v)).where("rank = 1").select("incident_id", F.col("root_type").alias("said"))
    return v.incidents().join(t, "incident_id").groupBy(F.col("root_type").alias("truth"), "said").agg(F.count("*").alias("n"))


@query("evl_04_confusion", _CONF)
def _(v):
    return confusion(v)


@query("evl_05_conditioned_hits", "SELECT avg(CASE WHEN r.root_service=i.root_service THEN 1.0 ELSE 0.0 END) AS service_hit, avg(CASE WHEN r.root_service=i.root_service AND r.root_metric=i.root_metric THEN 1.0 ELSE 0.0 END) AS pair_hit FROM v_incidents i JOIN v_root r USING (incident_id)")
def _(v):
    j = v.incidents().join(roots(v).select("incident_id", F.col("root_service").alias("s"), F.col("root_metric").alias("m")), "incident_id")
    same = F.col("s") == F.col("root_service")
    return j.agg(F.avg(same.cast("double")).alias("service_hit"), F.avg((same & (F.col("m") == F.col("root_metric"))).cast("double")).alias("pair_hit"))


@query("evl_06_fault_summaries", f"SELECT coalesce(root_type, 'all') AS fault, avg(CASE WHEN pos>0 THEN 1.0/pos ELSE 0.0 END) AS mrr, min(CASE WHEN pos>0 THEN 1.0/pos ELSE 0.0 END) AS worst, count(*) AS n FROM ({_POS}) p JOIN v_incidents i ON i.incident_id=p.incident_id GROUP BY ROLLUP (root_type)")
def _(v):
    p = D.positions(v.incidents(), results(v), F.col("root_service")).withColumn("rr", F.when(F.col("pos") > 0, 1.0 / F.col("pos")).otherwise(0.0))
    t = p.rollup("root_type").agg(F.avg("rr").alias("mrr"), F.min("rr").alias("worst"), F.count("*").alias("n"))
    return t.select(F.coalesce("root_type", F.lit("all")).alias("fault"), "mrr", "worst", "n")


@query("evl_07_weighted_overall", f"SELECT sum(n*m)/sum(n) AS weighted, sum(n*m)/sum(n)>=0.5 AS accepted FROM (SELECT root_type, count(*) AS n, avg(CASE WHEN pos>0 THEN 1.0/pos ELSE 0.0 END) AS m FROM ({_POS}) p JOIN v_incidents i ON i.incident_id=p.incident_id GROUP BY 1)")
def _(v):
    p = D.positions(v.incidents(), results(v), F.col("root_service")).withColumn("rr", F.when(F.col("pos") > 0, 1.0 / F.col("pos")).otherwise(0.0))
    t = p.groupBy("root_type").agg(F.count("*").alias("n"), F.avg("rr").alias("m"))
    return t.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("weighted")).withColumn("accepted", F.col("weighted") >= 0.5)


@query("evl_08_gate", f"SELECT bool_and(pos IS NOT NULL AND pos<=5) AS passed, count(*) FILTER (pos>5) AS failed FROM ({_POS})")
def _(v):
    p = D.positions(v.incidents(), results(v), F.col("root_service"))
    return p.agg(F.bool_and(F.coalesce((F.col("pos") >= 1) & (F.col("pos") <= 5), F.lit(False))).alias("passed"), F.count(F.when(F.col("pos") > 5, 1)).alias("failed"))


@query("evl_09_run_summary", "SELECT metric, avg(r) AS mean, min(r) AS least, max(r) AS most FROM (SELECT incident_id, metric, max(intervention_score) AS r FROM v_ipw GROUP BY 1,2) GROUP BY 1")
def _(v):
    t = ipw(v).groupBy("incident_id", "metric").agg(F.max("intervention_score").alias("r"))
    return t.groupBy("metric").agg(F.avg("r").alias("mean"), F.min("r").alias("least"), F.max("r").alias("most"))


@query("evl_10_ablation", "SELECT i.incident_id, s.rank AS without_evidence, m.semantic_rank AS with_evidence, s.rank-m.semantic_rank AS gain FROM v_incidents i JOIN v_sparse s ON s.incident_id=i.incident_id AND s.service=root_service AND s.metric=root_metric JOIN v_sem m ON m.incident_id=i.incident_id AND m.service=root_service AND m.metric=root_metric")
def _(v):
    i = v.incidents().select("incident_id", F.col("root_service").alias("service"), F.col("root_metric").alias("metric"))
    j = i.join(sparse(v).select("incident_id", "service", "metric", F.col("rank").alias("without_evidence")), ["incident_id", "service", "metric"]).join(semantic(v).select("incident_id", "service", "metric", F.col("semantic_rank").alias("with_evidence")), ["incident_id", "service", "metric"])
    return j.select("incident_id", "without_evidence", "with_evidence", (F.col("without_evidence") - F.col("with_evidence")).alias("gain"))


@query("evl_11_failure_patterns", "SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN r.root_service=i.root_service AND r.root_metric=i.root_metric THEN 'correct' WHEN r.root_service=i.root_service THEN 'sibling_metric' WHEN list_contains(injected_path, r.root_service) THEN 'downstream_symptom' ELSE 'wrong_service' END AS pattern FROM v_incidents i JOIN v_root r USING (incident_id)) GROUP BY 1")
def _(v):
    j = v.incidents().join(roots(v).select("incident_id", F.col("root_service").alias("s"), F.col("root_metric").alias("m")), "incident_id")
    same = F.col("s") == F.col("root_service")
    kind = F.when(same & (F.col("m") == F.col("root_metric")), "correct").when(same, "sibling_metric").when(F.array_contains("injected_path", F.col("s")), "downstream_symptom").otherwise("wrong_service")
    return j.groupBy(kind.alias("pattern")).agg(F.count("*").alias("n"))


@query("evl_12_root_vs_predicted", "SELECT i.incident_id, a.semantic_score AS root_score, b.semantic_score AS said_score, b.semantic_score-a.semantic_score AS difference FROM v_incidents i JOIN v_sem a ON a.incident_id=i.incident_id AND a.service=root_service AND a.metric=root_metric JOIN v_sem b ON b.incident_id=i.incident_id AND b.semantic_rank=1")
def _(v):
    s = semantic(v)
    i = v.incidents().select("incident_id", F.col("root_service").alias("service"), F.col("root_metric").alias("metric"))
    a = i.join(s.select("incident_id", "service", "metric", F.col("semantic_score").alias("root_score")), ["incident_id", "service", "metric"])
    j = a.join(s.where("semantic_rank = 1").select("incident_id", F.col("semantic_score").alias("said_score")), "incident_id")
    return j.select("incident_id", "root_score", "said_score", (F.col("said_score") - F.col("root_score")).alias("difference"))


@query("evl_13_channel_check", "SELECT i.incident_id, g.signal AS root_signal, (SELECT count(*) FROM v_signal h WHERE h.incident_id=i.incident_id AND h.signal>g.signal)+1 AS root_rank FROM v_incidents i JOIN v_signal g ON g.incident_id=i.incident_id AND g.service=root_service AND g.metric=root_metric")
def _(v):
    s = signal(v).withColumn("root_rank", F.rank().over(Window.partitionBy("incident_id").orderBy(F.desc("signal"))))
    i = v.incidents().select("incident_id", F.col("root_service").alias("service"), F.col("root_metric").alias("metric"))
    return i.join(s, ["incident_id", "service", "metric"]).select("incident_id", F.col("signal").alias("root_signal"), "root_rank")


@query("evl_14_sequence_continuity", "SELECT service, min(event_id) AS first, max(event_id) AS last, count(*) AS n, CAST(sum(CASE WHEN gap>1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, count(*)-count(DISTINCT event_id) AS duplicates FROM (SELECT service, event_id, event_id-lag(event_id) OVER (PARTITION BY service ORDER BY event_id) AS gap FROM v_metrics) GROUP BY 1")
def _(v):
    return D.continuity(v.metrics(), "service", "event_id")
