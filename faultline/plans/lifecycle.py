"""Queries for model lifecycles and for how far a candidate can be told from the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import chain as C
from faultline.operators import diagnosis as D
from faultline.operators import lifecycle as M
from faultline.operators.tables import written

from . import chain, learner
from .views import SQL, query

CACHE = 2
SQL["v_mevents"] = """SELECT t.service, t.win, t.state, sha256(t.service||'|'||coalesce(string_agg(parent, '|' ORDER BY parent), '')) AS fingerprint FROM v_ctimeline t LEFT JOIN v_wedges e ON e.target=t.service AND e.snapshot_id=t.win//28 WHERE state<>previous GROUP BY 1,2,3"""
SQL["v_muses"] = """SELECT a.*, last IS NOT NULL AND (SELECT count(DISTINCT b.fingerprint) FROM v_mevents b WHERE b.state IN ('soft','hard') AND b.service=a.service AND b.win>a.last AND b.win<a.win)<2 AS cached
 FROM (SELECT *, lag(win) OVER (PARTITION BY service, fingerprint ORDER BY win) AS last FROM v_mevents WHERE state IN ('soft','hard')) a"""
SQL["v_mrows"] = """WITH s AS (SELECT e.*, u.cached, lag(e.state) OVER (PARTITION BY e.service ORDER BY e.win) AS before, last_value(CASE WHEN e.state IN ('soft','hard') THEN e.fingerprint END IGNORE NULLS) OVER (PARTITION BY e.service ORDER BY e.win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM v_mevents e LEFT JOIN v_muses u USING (service, win)),
 a AS (SELECT *, CASE state WHEN 'soft' THEN CASE WHEN cached THEN 'prepare_cached' ELSE 'prepare' END WHEN 'hard' THEN CASE WHEN before IN ('soft','recovery') AND held=fingerprint THEN 'freeze' WHEN before IN ('soft','recovery') THEN 'rebuild' ELSE 'freeze_unprepared' END WHEN 'recovery' THEN 'recover' ELSE CASE WHEN before='soft' THEN 'archive' ELSE 'close' END END AS action FROM s),
 f AS (SELECT *, CASE state WHEN 'soft' THEN 'PREPARED' WHEN 'hard' THEN 'FROZEN' ELSE CASE WHEN action='archive' THEN 'ARCHIVED' ELSE 'RECOVERED' END END AS status,
  CASE WHEN state IN ('soft','hard') THEN max(CASE WHEN action IN ('prepare','rebuild','freeze_unprepared') THEN win END) OVER k END AS f0, CASE WHEN state IN ('soft','hard') THEN count(CASE WHEN action IN ('prepare','rebuild','freeze_unprepared') THEN 1 END) OVER k END AS v0
  FROM a WINDOW k AS (PARTITION BY service, fingerprint, state IN ('soft','hard') ORDER BY win))
 SELECT service, win, state, last_value(CASE WHEN f0 IS NOT NULL THEN fingerprint END IGNORE NULLS) OVER w AS fingerprint, action, status, last_value(f0 IGNORE NULLS) OVER w AS fitted_at, last_value(v0 IGNORE NULLS) OVER w AS version FROM f WINDOW w AS (PARTITION BY service ORDER BY win ROWS UNBOUNDED PRECEDING)"""
SQL["v_mtrained"] = """SELECT service, win, CAST(n AS BIGINT) AS rows, slope, CASE WHEN n>0 THEN (sy-slope*sx)/n END AS intercept, n>=10 AS ready FROM (SELECT *, CASE WHEN n>0 THEN (sxy-sx*sy/n)/(sxx-sx*sx/n+1) END AS slope FROM (
 SELECT service, win, coalesce(sum(CASE WHEN ok THEN 1.0::DOUBLE END) OVER p, 0) AS n, coalesce(sum(CASE WHEN ok THEN x END) OVER p, 0) AS sx, coalesce(sum(CASE WHEN ok THEN score END) OVER p, 0) AS sy, coalesce(sum(CASE WHEN ok THEN x*x END) OVER p, 0) AS sxx, coalesce(sum(CASE WHEN ok THEN x*score END) OVER p, 0) AS sxy
 FROM (SELECT *, state='healthy' AND x IS NOT NULL AS ok FROM (SELECT *, lag(score) OVER (PARTITION BY service ORDER BY win) AS x FROM v_ctimeline)) WINDOW p AS (PARTITION BY service ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def timeline(v):
    windows = C.accumulated(v.spark.createDataFrame([], C.OPEN), v.metrics().select("service", "metric", F.floor(F.col("timestamp") / chain.RULE.width).alias("win"), "value"))
    scores, _ = C.scored(windows, v.spark.createDataFrame([], C.MEMORY), chain.RULE)
    return written(C.alerted(written(scores), v.spark.createDataFrame([], C.ALERTS), chain.RULE)[0])


@query("prp_20_model_lifecycle", "SELECT r.*, rows, slope, intercept, ready FROM v_mrows r LEFT JOIN (SELECT service, win AS fitted_at, rows, slope, intercept, ready FROM v_mtrained) t USING (service, fitted_at)")
def _(v):
    t = timeline(v)
    _, _, _, edges, _ = learner.inputs(v)
    weekly = edges.select("snapshot_id", "parent", F.col("target").alias("service"))
    changes = t.where("state <> previous").select("service", "win", "state", F.floor(F.col("win") / 28).alias("snapshot_id"))
    named = changes.join(weekly, ["service", "snapshot_id"], "left").groupBy("service", "win", "state").agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    events = written(named.select("service", "win", "state", F.sha2(F.concat(F.col("service"), F.lit("|"), F.concat_ws("|", "parents")), 256).alias("fingerprint")))
    models = M.trained(t).withColumnRenamed("win", "fitted_at")
    return M.transitions(events, CACHE).join(models, ["service", "fitted_at"], "left")


SQL["v_ident"] = """WITH c AS (SELECT service, win, node AS root_service, greatest(m.residual, 0)*pow(0.8, hop) AS gain, hop FROM (SELECT t.service, t.win FROM v_ctimeline t JOIN v_cmodel o ON o.service=t.service AND o.win=t.win WHERE t.state='hard' AND t.previous<>'hard' AND o.ready) h JOIN v_creach ON seed=h.service JOIN (SELECT service AS node, win AS mw, residual FROM v_cmodel WHERE residual IS NOT NULL) m USING (node) WHERE mw=win),
 r AS (SELECT *, gain/(sum(gain) OVER (PARTITION BY service, win)+1e-12) AS relative FROM c),
 cf AS (SELECT r.*, CASE WHEN o.med IS NULL THEN 1.0 ELSE least(greatest(relative/(relative+o.med+1e-12), 0), 1) END AS cf FROM r LEFT JOIN (SELECT a.service, a.win, a.root_service, median(b.relative) AS med FROM r a JOIN r b ON a.service=b.service AND a.win=b.win AND b.relative>0 AND b.relative<>a.relative GROUP BY 1,2,3) o USING (service, win, root_service)),
 mg AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY service, win)=1 THEN 1.0 ELSE greatest(relative-coalesce(lead(relative) OVER (PARTITION BY service, win ORDER BY relative DESC, root_service), 0), 0)/greatest(relative, 1e-12) END AS margin, 1/(1.0::DOUBLE+hop) AS path FROM cf),
 sig AS (SELECT service AS root_service, win, metric, coalesce(score, 0) AS x FROM v_cscores),
 nrm AS (SELECT root_service, win, sqrt(sum(x*x)) AS n FROM sig GROUP BY 1,2),
 cos AS (SELECT a.root_service, b.root_service AS other, a.win, abs(sum(a.x*b.x)) AS dot FROM sig a JOIN sig b ON a.win=b.win AND a.metric=b.metric AND a.root_service<>b.root_service GROUP BY 1,2,3),
 coh AS (SELECT a.service, a.win, a.root_service, max(CASE WHEN na.n=0 THEN 0 ELSE coalesce(dot, 0)/(na.n*nb.n+1e-12) END) AS coherence FROM mg a JOIN mg b ON a.service=b.service AND a.win=b.win AND a.root_service<>b.root_service JOIN nrm na ON na.root_service=a.root_service AND na.win=a.win JOIN nrm nb ON nb.root_service=b.root_service AND nb.win=b.win LEFT JOIN cos ON cos.root_service=a.root_service AND cos.other=b.root_service AND cos.win=a.win GROUP BY 1,2,3),
 ent AS (SELECT root_service, win, CASE WHEN count(*) FILTER (x>0)<=1 THEN 0 ELSE -sum(CASE WHEN x>0 THEN x/t*ln(x/t) ELSE 0 END)/ln(count(*) FILTER (x>0)) END AS entropy FROM (SELECT *, sum(x) OVER (PARTITION BY root_service, win) AS t FROM sig) GROUP BY 1,2),
 q AS (SELECT service AS root_service, win, sum(n)/(sum(n)+2.0::DOUBLE) AS quality FROM (SELECT service, CAST(floor(timestamp/21600) AS BIGINT) AS win, count(*) AS n FROM v_metrics GROUP BY 1,2) GROUP BY 1,2),
 i AS (SELECT mg.*, coalesce(coherence, 0) AS coherence, entropy, quality, least(greatest((0.5*cf+0.2*path+0.3*margin)*(1-(0.7*coalesce(coherence, 0)+0.3*entropy)), 0), 1) AS identifiability FROM mg LEFT JOIN coh USING (service, win, root_service) JOIN ent USING (root_service, win) JOIN q USING (root_service, win))
 SELECT service, win, root_service, hop, gain, relative, cf, path, margin, coherence, entropy, quality, identifiability, least(greatest(0.4*cf+0.2*margin+0.2*quality+0.2*identifiability, 0), 1) AS confidence FROM i"""


def told_apart(v, out, reach):
    """Candidates of the hard alerts of a chain's results, with how far each can be told from the others."""
    own = out["predictions"].where("ready").select("service", "win")
    hard = out["timeline"].where("state = 'hard' and previous <> 'hard'").select("service", "win").join(own, ["service", "win"], "left_semi")
    left = out["predictions"].where("residual is not null").select(F.col("service").alias("root_service"), "win", F.greatest("residual", F.lit(0.0)).alias("left"))
    near = hard.join(reach.select(F.col("seed").alias("service"), F.col("node").alias("root_service"), "hop"), "service").join(left, ["root_service", "win"])
    gains = written(near.select("service", "win", "root_service", "hop", (F.col("left") * F.pow(F.lit(chain.RULE.decay), F.col("hop"))).alias("gain")))
    signature = out["scores"].select(F.col("service").alias("root_service"), "win", "metric", F.coalesce("score", F.lit(0.0)).alias("x"))
    quality = v.metrics().groupBy(F.col("service").alias("root_service"), F.floor(F.col("timestamp") / chain.RULE.width).alias("win")).agg((F.count("*") / (F.count("*") + 2.0)).alias("quality"))
    return D.told_apart(gains, signature, quality)


@query("dia_08_identifiability", "SELECT service, win, root_service, cf, path, margin, coherence, entropy, quality, identifiability, confidence FROM v_ident")
def _(v):
    parents, reach = chain.topology(v)
    return told_apart(v, C.whole(chain.rows(v), parents, reach, chain.RULE), reach).drop("hop", "gain", "relative")
