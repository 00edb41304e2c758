"""Queries for the reports of hard alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import chain as C
from faultline.operators import report as R
from faultline.operators.tables import written

from . import chain, lifecycle, roots
from .views import SQL, query

GATES, ALERT = R.Gates(), ["service", "win"]

SQL["v_gated"] = """SELECT *, row_number() OVER (PARTITION BY service, win ORDER BY round(relative, 9) DESC, root_service) AS rank, list_filter([CASE WHEN relative<0.2 THEN 'low_counterfactual' END, CASE WHEN margin<0.1 THEN 'low_margin' END,
 CASE WHEN identifiability<0.1 THEN 'low_identifiability' END, CASE WHEN confidence<0.4 THEN 'low_confidence' END, CASE WHEN gain<=0 THEN 'zero_candidate_signature' END], lambda x: x IS NOT NULL) AS against FROM v_ident"""
SQL["v_primary"] = """SELECT service, win, CASE WHEN root IS NULL THEN 'ambiguous' WHEN strong THEN 'strong' ELSE 'weak' END AS status, root AS primary_root, CASE WHEN root IS NOT NULL THEN confidence END AS confidence, CASE WHEN root IS NULL THEN why ELSE [] END AS reasons, candidates FROM (
 SELECT service, win, arg_min(root_service, rank) FILTER (len(against)=0) AS root, arg_min(confidence>=0.6 AND identifiability>=0.3, rank) FILTER (len(against)=0) AS strong, arg_min(confidence, rank) FILTER (len(against)=0) AS confidence, arg_min(against, rank) AS why, count(*) AS candidates FROM v_gated GROUP BY 1,2)"""
SQL["v_groups"] = """SELECT service, win, entity, category, strength, ms[k] AS metric, CASE WHEN score>0 THEN cs[k]*score/(qs[k]*score+effective) ELSE 0 END AS contribution, rs[k] AS residual FROM (
 SELECT *, unnest(range(1, len(ms)+1)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY service, win ORDER BY round(score, 9) DESC, entity, category) AS rank FROM v_rgroups) WHERE rank<=3)"""
SQL["v_rpaths"] = "SELECT split_part(incident_id, '@', 1) AS service, CAST(split_part(incident_id, '@', 2) AS BIGINT) AS win, split_part(root, '.', 1) AS entity, path, score, hops FROM v_paths"
#: Errors of a candidate in the window of the alert are used evidence, those of the window before are excluded.
SQL["v_burst"] = """SELECT h.service, h.win, node AS entity, 'error_rate@'||e.win AS source, least(n/5.0::DOUBLE, 1) AS strength, e.win=h.win AS used FROM (SELECT DISTINCT service, win FROM v_ident) h JOIN v_creach ON seed=h.service
 JOIN (SELECT service AS s, CAST(floor(timestamp/21600) AS BIGINT) AS win, count(*) AS n FROM v_metrics WHERE metric='request.error_rate' GROUP BY 1,2) e ON e.s=node AND e.win IN (h.win, h.win-1)"""
SQL["v_chain_rows"] = """SELECT service, win, entity AS candidate, 'source_anomaly' AS kind, metric AS source, residual AS strength FROM v_groups WHERE contribution>0 UNION ALL SELECT service, win, entity, 'solver_contribution', metric, contribution FROM v_groups WHERE contribution>0
 UNION ALL SELECT service, win, root_service, 'counterfactual', root_service, relative FROM v_gated UNION ALL SELECT service, win, entity, CASE WHEN used THEN 'normalized_evidence' ELSE 'excluded_evidence' END, source, CASE WHEN used THEN strength ELSE 0 END FROM v_burst
 UNION ALL SELECT service, win, entity, 'propagation_path', path, score FROM v_rpaths"""


def parts(v) -> dict:
    """Everything that the reports of the hard alerts rest on, each written once."""
    parents, reach = chain.topology(v)
    out = C.whole(chain.rows(v), parents, reach, chain.RULE)
    ranked = written(R.gated(lifecycle.told_apart(v, out, reach), ALERT, GATES))
    groups = written(roots.ranked(v, out, reach))
    incident = F.split("incident_id", "@")
    found = written(chain.paths_of(v, out, parents).select(incident[0].alias("service"), incident[1].cast("long").alias("win"), F.substring_index("root", ".", 1).alias("entity"), "root", "path", "score", "rank"))
    errors = v.metrics().where("metric = 'request.error_rate'").groupBy(F.col("service").alias("entity"), F.floor(F.col("timestamp") / chain.RULE.width).alias("at")).agg(F.count("*").alias("n"))
    near = ranked.select(*ALERT).distinct().join(reach.select(F.col("seed").alias("service"), F.col("node").alias("entity")), "service").withColumn("at", F.explode(F.array("win", F.col("win") - 1)))
    burst = near.join(errors, ["entity", "at"]).select(*ALERT, "entity", F.concat(F.lit("error_rate@"), F.col("at").cast("string")).alias("source"), F.least(F.col("n") / 5.0, F.lit(1.0)).alias("strength"), (F.col("at") == F.col("win")).alias("used"))
    pieces = R.evidence_chain(ranked, groups, burst, found.withColumn("source", F.concat_ws(">", "path")), ALERT)
    return {"ranked": ranked, "groups": groups, "paths": found, "chain": pieces, "choice": R.primary(ranked, ALERT, GATES)}


@query("dia_13_chain_rows", "SELECT * FROM v_chain_rows")
def _(v):
    return parts(v)["chain"]


@query("dia_14_nested_report", """SELECT p.service, p.win, status, primary_root, p.confidence, array_to_string(reasons, ',') AS reasons, candidates, ranking, coalesce(pieces, 0) AS pieces, coalesce(total, 0) AS total, coalesce(n_paths, 0) AS n_paths, coalesce(best, 0) AS best FROM v_primary p
 JOIN (SELECT service, win, string_agg(root_service, ',' ORDER BY rank) AS ranking FROM v_gated GROUP BY 1,2) r USING (service, win) LEFT JOIN (SELECT service, win, count(*) AS pieces, sum(strength) AS total FROM v_chain_rows GROUP BY 1,2) c USING (service, win) LEFT JOIN (SELECT service, win, count(*) AS n_paths, max(score) AS best FROM v_rpaths GROUP BY 1,2) q USING (service, win)""")
def _(v):
    x = parts(v)
    report = R.nested(x["choice"], x["ranked"], x["chain"], x["paths"], ALERT)
    sum_ = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, e: f(a, e))
    return report.select(
        *ALERT, "status", "primary_root", "confidence", F.concat_ws(",", "reasons").alias("reasons"), "candidates", F.concat_ws(",", F.transform("ranked_candidates", lambda c: c["root_service"])).alias("ranking"),
        F.when(F.col("evidence_chain").isNull(), 0).otherwise(F.size("evidence_chain")).alias("pieces"), F.coalesce(sum_("evidence_chain", lambda a, e: a + e["strength"]), F.lit(0.0)).alias("total"),
        F.when(F.col("paths").isNull(), 0).otherwise(F.size("paths")).alias("n_paths"), F.coalesce(F.array_max(F.transform("paths", lambda p: p["score"])), F.lit(0.0)).alias("best"),
    )


@query("dia_17_result_of_alert", """WITH u AS (SELECT * FROM v_groups WHERE contribution>0), m AS (SELECT service, win, string_agg(n, ',' ORDER BY r) AS top_metrics FROM (SELECT service, win, entity||'.'||metric AS n, row_number() OVER (PARTITION BY service, win ORDER BY round(contribution, 9) DESC, entity||'.'||metric) AS r FROM u) WHERE r<=5 GROUP BY 1,2),
 s AS (SELECT service, win, string_agg(entity||'/'||best, ',' ORDER BY r) AS top_services, arg_min(entity, r) AS first FROM (SELECT service, win, entity, best, row_number() OVER (PARTITION BY service, win ORDER BY round(x, 9) DESC, entity) AS r FROM (SELECT service, win, entity, max(contribution) AS x, arg_max(metric, {'c': round(contribution, 9), 'm': metric}) AS best FROM u GROUP BY 1,2,3)) WHERE r<=5 GROUP BY 1,2),
 k AS (SELECT service, win, arg_min(category, r) AS root_type FROM (SELECT service, win, category, row_number() OVER (PARTITION BY service, win ORDER BY round(sum(contribution), 9) DESC, category) AS r FROM u GROUP BY 1,2,3) GROUP BY 1,2),
 p AS (SELECT service, win, arg_min(path, r) AS path FROM (SELECT *, row_number() OVER (PARTITION BY service, win ORDER BY round(score, 9) DESC, hops, path) AS r FROM v_rpaths) GROUP BY 1,2)
 SELECT service, win, top_metrics, top_services, root_type, coalesce(path, first) AS path FROM m JOIN s USING (service, win) JOIN k USING (service, win) LEFT JOIN p USING (service, win)""")
def _(v):
    x = parts(v)
    out = R.result_rows(x["groups"], x["paths"], ALERT)
    return out.select(*ALERT, F.concat_ws(",", "top_metrics").alias("top_metrics"), F.concat_ws(",", "top_services").alias("top_services"), "root_type", F.concat_ws(">", "path").alias("path"))
