"""Queries for ranked root candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import chain as C
from faultline.operators import roots as R
from faultline.operators.tables import written

from . import chain
from .views import SQL, query

PENALTIES = {"CPU": 1.0, "network": 0.8, "storage I/O": 0.9, "load": 1.2}
L1, ETA, KEEP = 0.2, 2.0, 3

SQL["v_rrows"] = """SELECT h.service, h.win, s.service AS entity, CASE WHEN metric LIKE 'cpu.%' THEN 'CPU' WHEN metric LIKE 'net.%' THEN 'network' WHEN metric LIKE 'io.%' THEN 'storage I/O' ELSE 'load' END AS category, metric, score AS residual, n/(n+2.0::DOUBLE) AS quality
 FROM (SELECT service, win FROM v_ctimeline WHERE state='hard' AND previous<>'hard') h JOIN v_creach ON seed=h.service JOIN v_cscores s ON s.service=node AND s.win=h.win AND score IS NOT NULL JOIN (SELECT service, metric, CAST(floor(timestamp/21600) AS BIGINT) AS win, count(*) AS n FROM v_metrics GROUP BY 1,2,3) c USING (metric) WHERE c.service=s.service AND c.win=h.win"""
SQL["v_rgroups"] = """SELECT *, CASE WHEN sqrt(list_sum(list_transform(cs, lambda x: x*x)))<=effective THEN 0 ELSE (t.lo+t.hi)/2 END AS score FROM (
 SELECT *, list_reduce(list_transform(range(0, 61), lambda i: {'lo': 0.0::DOUBLE, 'hi': sqrt(list_sum(list_transform(range(1, len(cs)+1), lambda k: pow(cs[k]/qs[k], 2))))}), lambda s, i: CASE WHEN list_sum(list_transform(range(1, len(cs)+1), lambda k: pow(cs[k]/(qs[k]*(s.lo+s.hi)/2+effective), 2)))>1 THEN {'lo': (s.lo+s.hi)/2, 'hi': s.hi} ELSE {'lo': s.lo, 'hi': (s.lo+s.hi)/2} END) AS t
 FROM (SELECT g.*, coalesce(strength, 0) AS strength, base, base/(1+2*coalesce(strength, 0)) AS effective FROM (SELECT service, win, entity, category, list(metric ORDER BY metric) AS ms, list(greatest(quality*residual-0.2, 0) ORDER BY metric) AS cs, list(quality ORDER BY metric) AS qs, list(residual ORDER BY metric) AS rs FROM v_rrows GROUP BY 1,2,3,4) g
  JOIN (SELECT * FROM (VALUES ('CPU', 1.0::DOUBLE), ('network', 0.8), ('storage I/O', 0.9), ('load', 1.2)) p(category, base)) USING (category) LEFT JOIN (SELECT service AS entity, CAST(floor(timestamp/21600) AS BIGINT) AS win, least(count(*)/5.0::DOUBLE, 1) AS strength FROM v_metrics WHERE metric='request.error_rate' GROUP BY 1,2) e USING (entity, win)))"""


def ranked(v, out, reach):
    """The best groups of the hard alerts of a chain's results, with what they rest on."""
    hard = out["timeline"].where("state = 'hard' and previous <> 'hard'").select("service", "win")
    m = v.metrics().withColumn("win", F.floor(F.col("timestamp") / chain.RULE.width))
    counts = m.groupBy(F.col("service").alias("entity"), "metric", "win").agg((F.count("*") / (F.count("*") + 2.0)).alias("quality"))
    near = written(hard.join(reach.select(F.col("seed").alias("service"), F.col("node").alias("entity")), "service"))
    scores = out["scores"].where("score is not null").select(F.col("service").alias("entity"), "win", "metric", F.col("score").alias("residual"))
    rows = near.join(scores, ["entity", "win"]).join(counts, ["entity", "metric", "win"]).withColumn("category", S.metric_family(F.col("metric")))
    errors = m.where("metric = 'request.error_rate'").groupBy(F.col("service").alias("entity"), "win").agg(F.least(F.count("*") / 5.0, F.lit(1.0)).alias("strength"))
    evidence = near.join(errors, ["entity", "win"]).select("service", "win", "entity", "strength")
    penalties = v.spark.createDataFrame(list(PENALTIES.items()), "category string, base double")
    return R.ranked_roots(rows, ["service", "win"], penalties, evidence, L1, ETA, KEEP)


@query("inv_12_root_contributions", """SELECT service, win, entity, category, rank, score, base, effective, strength, ms[k] AS metric, CASE WHEN score>0 THEN cs[k]*score/(qs[k]*score+effective) ELSE 0 END AS contribution, rs[k] AS residual, qs[k] AS quality FROM (
 SELECT *, unnest(range(1, len(ms)+1)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY service, win ORDER BY round(score, 9) DESC, entity, category) AS rank FROM v_rgroups) WHERE rank<=3)""")
def _(v):
    parents, reach = chain.topology(v)
    return ranked(v, C.whole(chain.rows(v), parents, reach, chain.RULE), reach)
