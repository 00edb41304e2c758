"""Queries for the whole chain, in batch and as one stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators import chain as C
from faultline.operators import paths as P
from faultline.operators import topology as T
from faultline.operators.tables import scratch, written
from faultline.streaming import chain as S

from .streams import replayed_through
from .views import DAY0, SQL, query

RULE = C.Rule()
LATE_RULE = C.Rule(width=86400.0, lateness=86400.0)


def states_sql(source: str, rule: C.Rule) -> str:
    """The alert states of source (service, win, score) as a recursion over each service's windows."""
    soft, hard = f"o.score>={rule.soft}", f"o.score>={rule.hard}"
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY win) AS r FROM {source}),
 f AS (SELECT DISTINCT service, 0::BIGINT AS r, NULL::BIGINT AS win, NULL::DOUBLE AS score, false AS ready, 0 AS s, 0 AS h, 0 AS calm, 'healthy' AS state, 'healthy' AS previous FROM o
  UNION ALL SELECT service, r, win, score, ready, s, h, calm, CASE WHEN h>={rule.hard_n} THEN 'hard' WHEN previous='hard' THEN CASE WHEN calm>={rule.recover_n} THEN 'recovery' ELSE 'hard' END
    WHEN previous='recovery' THEN CASE WHEN calm>={rule.recover_n + rule.cooldown} THEN 'healthy' ELSE 'recovery' END WHEN s>={rule.soft_n} THEN 'soft' WHEN previous='soft' THEN CASE WHEN calm>=1 THEN 'healthy' ELSE 'soft' END ELSE 'healthy' END, previous
   FROM (SELECT o.service, o.r, o.win, o.score, o.ready, CASE WHEN {soft} THEN f.s+1 ELSE 0 END AS s, CASE WHEN {hard} THEN f.h+1 ELSE 0 END AS h, CASE WHEN {soft} THEN 0 ELSE f.calm+1 END AS calm, f.state AS previous FROM f JOIN o ON o.service=f.service AND o.r=f.r+1))
 SELECT service, win, score, ready, previous, state FROM f WHERE r>0"""


#: The two services whose events most often come just before a service's on its node are its parents.
SQL["v_flow"] = """SELECT parent, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, parent) AS r FROM (SELECT before AS parent, service AS target, count(*) AS n FROM
 (SELECT *, lag(service) OVER (PARTITION BY node ORDER BY timestamp, event_id) AS before FROM v_metrics) WHERE before<>service GROUP BY 1,2)) WHERE r<=2"""
SQL["v_cscores"] = """SELECT service, metric, win, value, CASE WHEN count(*) OVER w>=3 THEN least(greatest((value-avg(value) OVER w)/greatest(stddev_pop(value) OVER w, 10), 0), 10) END AS score
 FROM (SELECT service, metric, CAST(floor(timestamp/21600) AS BIGINT) AS win, avg(value) AS value FROM v_metrics GROUP BY 1,2,3) WINDOW w AS (PARTITION BY service, metric ORDER BY win ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"""
SQL["v_cwindows"] = "SELECT service, win, coalesce(max(score), 0) AS score, count(score)>0 AS ready FROM v_cscores GROUP BY 1,2"
SQL["v_ctimeline"] = states_sql("v_cwindows", RULE)
SQL["v_cbreaks"] = "SELECT win FROM (SELECT win, lag(win) OVER (ORDER BY win) AS before FROM (SELECT DISTINCT win FROM v_cwindows)) WHERE win-before>2"
SQL["v_cfeatures"] = """WITH par AS (SELECT parent, target FROM v_flow UNION SELECT service, service FROM (SELECT parent AS service FROM v_flow UNION SELECT target FROM v_flow UNION SELECT service FROM v_cwindows)),
 g AS (SELECT win, target, parent FROM (SELECT DISTINCT win FROM v_cwindows) CROSS JOIN par),
 f AS (SELECT g.*, s.score AS x, CASE WHEN k.win IS NULL OR EXISTS (SELECT 1 FROM v_cbreaks b WHERE b.win=g.win) THEN 'insufficient_history' WHEN s.score IS NULL THEN 'missing_parent_state' WHEN NOT s.ready THEN 'baseline_not_ready' END AS why
  FROM g LEFT JOIN (SELECT DISTINCT win FROM v_cwindows) k ON k.win=g.win-1 LEFT JOIN v_cwindows s ON s.service=g.parent AND s.win=g.win-1),
 w AS (SELECT target, win, list(parent ORDER BY parent) AS keys, list(x ORDER BY parent) AS xs, list_filter(list(why ORDER BY parent), lambda r: r IS NOT NULL)[1] AS why FROM f GROUP BY 1,2)
 SELECT w.target, w.win, keys, CASE WHEN why IS NULL THEN xs END AS x, CASE WHEN s.score IS NULL THEN 'missing_target' ELSE why END AS reason, s.score AS y, coalesce(e.learns, false) AND coalesce(s.ready, false) AS learns,
  CASE WHEN NOT coalesce(e.learns, false) THEN 'update_gate_closed' WHEN NOT s.ready THEN 'baseline_not_ready' END AS gate_reason
 FROM w LEFT JOIN v_cwindows s ON s.service=w.target AND s.win=w.win LEFT JOIN (SELECT win, NOT bool_or(state='hard') AS learns FROM v_ctimeline GROUP BY 1) e ON e.win=w.win"""
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({b})+1), lambda d: {a}[d]*{b}[d]))"
SQL["v_cmodel"] = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY win) AS k FROM v_cfeatures),
 m AS (SELECT target, 0::BIGINT AS k, 0::BIGINT AS win, list_transform(keys, lambda i: 0.0::DOUBLE) AS t, list_transform(keys, lambda i: list_transform(keys, lambda j: CASE WHEN i=j THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)) AS p, 0 AS updates, NULL::DOUBLE AS predicted, NULL::DOUBLE AS residual, NULL::VARCHAR AS reason FROM o WHERE k=1
  UNION ALL SELECT target, k, win, CASE WHEN go THEN list_transform(range(1, len(t)+1), lambda i: t[i] + px[i]/sc*(y-guess)) ELSE t END, CASE WHEN go THEN list_transform(range(1, len(t)+1), lambda i: list_transform(range(1, len(t)+1), lambda j: (p[i][j]-px[i]*px[j]/sc)/0.98)) ELSE p END,
   updates + CASE WHEN go THEN 1 ELSE 0 END, guess, y-guess, CASE WHEN reason IS NULL THEN gate_reason ELSE reason END
  FROM (SELECT *, 0.98 + {_DOT('x', 'px')} AS sc FROM (SELECT o.target, o.k, o.win, o.x, o.y, o.reason, o.gate_reason, m.t, m.p, m.updates, o.reason IS NULL AND o.learns AS go, CASE WHEN o.reason IS NULL THEN {_DOT('m.t', 'o.x')} END AS guess, CASE WHEN o.reason IS NULL THEN list_transform(m.p, lambda r: {_DOT('r', 'o.x')}) END AS px
   FROM m JOIN o ON o.target=m.target AND o.k=m.k+1))) SELECT target AS service, win, predicted, residual, predicted IS NOT NULL AND updates>=5 AS ready, reason FROM m WHERE k>0"""
SQL["v_creach"] = """SELECT seed, node, min(hop) AS hop FROM (SELECT service AS seed, service AS node, 0 AS hop FROM v_cwindows UNION ALL SELECT target, parent, 1 FROM v_flow UNION ALL SELECT a.target, b.parent, 2 FROM v_flow a JOIN v_flow b ON b.target=a.parent) GROUP BY 1,2"""
SQL["v_creports"] = """WITH h AS (SELECT t.service, t.win, m.ready AS own, m.reason AS why FROM v_ctimeline t LEFT JOIN v_cmodel m ON m.service=t.service AND m.win=t.win WHERE state='hard' AND previous<>'hard'),
 b AS (SELECT service, win, arg_max(metric, {'score': score, 'metric': metric}) AS metric FROM v_cscores WHERE score IS NOT NULL GROUP BY 1,2),
 r AS (SELECT h.service, h.win, node AS root_service, metric AS root_metric, greatest(residual, 0)*pow(0.8, hop) AS root_score, hop FROM h JOIN v_creach ON seed=h.service JOIN v_cmodel m ON m.service=node AND m.win=h.win AND m.residual IS NOT NULL JOIN b ON b.service=node AND b.win=h.win WHERE own)
 SELECT service, win, 'not_ready' AS status, CASE WHEN own IS NULL OR why IN ('insufficient_history', 'missing_parent_state', 'baseline_not_ready', 'missing_target') THEN coalesce(why, 'too_few_updates') ELSE 'too_few_updates' END AS reason, NULL::BIGINT AS rank, NULL::VARCHAR AS root_service, NULL::VARCHAR AS root_metric, NULL::DOUBLE AS root_score, NULL::INT AS hop FROM h WHERE NOT coalesce(own, false)
 UNION ALL SELECT service, win, 'diagnosed', NULL, rank, root_service, root_metric, root_score, hop FROM (SELECT *, row_number() OVER (PARTITION BY service, win ORDER BY round(root_score, 9) DESC, hop, root_service) AS rank FROM r) WHERE rank<=3"""


def with_previous(rows, key: str, order: list[str], value: str, name: str, cell: float = 3600.0):
    """rows plus ``name``: the value of the row before within key, along ``order`` (its first column is a time). The rows of a key are walked in
    time cells; only one row a cell is walked along the key, to give each cell's first row the last value of the cell before."""
    rows = rows.withColumn("_cell", F.floor(F.col(order[0]) / cell))
    w = Window.partitionBy(key, "_cell").orderBy(*order)
    rows = rows.withColumns({"_inside": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    last = rows.groupBy(key, "_cell").agg(F.max_by(F.struct(value), F.struct(*order))[value].alias("_last"))
    along = Window.partitionBy("_key").orderBy(F.col("_c").asc_nulls_first())
    ahead = last.select(F.col(key).alias("_key"), F.col("_cell").alias("_c"), "_last").withColumn("_ahead", F.lag("_last").over(along)).drop("_last")
    joined = rows.join(ahead, F.col(key).eqNullSafe(F.col("_key")) & F.col("_cell").eqNullSafe(F.col("_c")))
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_ahead")).otherwise(F.col("_inside"))).drop("_inside", "_first", "_cell", "_key", "_c", "_ahead")


def topology(v):
    """(parents, reach) of the services, written once."""
    n = with_previous(v.metrics(), "node", ["timestamp", "event_id"], "service", "parent").where("parent <> service").groupBy("parent", F.col("service").alias("target")).agg(F.count("*").alias("n"))
    parents = written(n.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "parent"))).where("r <= 2").select("parent", "target"))
    seeds = v.metrics().select(F.col("service").alias("seed")).distinct()
    reach = T.hops(seeds, parents.select(F.col("target").alias("src"), F.col("parent").alias("dst")), 2)
    return parents, written(reach.groupBy("seed", "node").agg(F.min("hop").alias("hop")))


def rows(v):
    return v.metrics().select("service", "metric", "timestamp", "value")


@query("dia_24_control_plane", "SELECT service, win, status, reason, rank, root_service, root_metric, root_score, hop FROM v_creports")
def _(v):
    return C.whole(rows(v), *topology(v), RULE)["reports"]


@query("dia_24_timeline", "SELECT service, win, score, ready, previous, state, coalesce(m.predicted, -1) AS predicted, m.reason FROM v_ctimeline LEFT JOIN (SELECT service, win, predicted, reason FROM v_cmodel) m USING (service, win)")
def _(v):
    out = C.whole(rows(v), *topology(v), RULE)
    return out["timeline"].join(out["predictions"].select("service", "win", F.coalesce("predicted", F.lit(-1.0)).alias("predicted"), "reason"), ["service", "win"], "left").select("service", "win", "score", "ready", "previous", "state", F.coalesce("predicted", F.lit(-1.0)).alias("predicted"), "reason")


@query("str_09_chain", "SELECT service, win, status, reason, rank, root_service, root_metric, root_score, hop FROM v_creports")
def _(v):
    folder = scratch(v.spark, "chain")
    chain = S.Chain(folder, *topology(v), RULE)
    replayed_through(v, rows(v).withColumn("ord", F.col("timestamp")), lambda stream: stream.drop("ord"), chain)
    chain.finish(v.spark)
    return S.results(v.spark, folder, "reports")


#: Rows arrive by up to four days late, by their value; each week's arrivals are one delivery.
SQL["v_arrivals"] = f"SELECT service, metric, timestamp, value, CAST(floor(timestamp/86400) AS BIGINT) AS win, CAST(floor((timestamp+value/490*345600-{DAY0})/604800) AS BIGINT) AS delivery FROM v_metrics"


@query("str_02_late_windows", """WITH d AS (SELECT delivery, max(max(timestamp)) OVER (ORDER BY delivery) AS top FROM v_arrivals GROUP BY 1), f AS (SELECT delivery, lag(CAST(floor((top-86400)/86400) AS BIGINT)-1) OVER (ORDER BY delivery) AS final FROM d)
 SELECT service, win, count(*) AS n, count(*) FILTER (win<=final) AS late, coalesce(sum(value) FILTER (win<=final), 0) AS late_value FROM v_arrivals JOIN f USING (delivery) GROUP BY 1,2""")
def _(v):
    folder = scratch(v.spark, "chain")
    chain = S.Chain(folder, *topology(v), LATE_RULE)
    delivery = F.floor((F.col("timestamp") + F.col("value") / 490 * 345600 - DAY0) / 604800)
    arrivals = rows(v).withColumn("ord", delivery.cast("double"))
    last = arrivals.agg(F.max("ord")).first()[0]
    replayed_through(v, arrivals, lambda stream: stream.drop("ord"), chain, cuts=[] if last is None else [float(i) for i in range(int(last))])
    late = S.results(v.spark, folder, "late").groupBy("service", "win").agg(F.count("*").alias("late"), F.sum("value").alias("late_value"))
    all_ = rows(v).groupBy("service", F.floor(F.col("timestamp") / LATE_RULE.width).alias("win")).agg(F.count("*").alias("n"))
    return all_.join(late, ["service", "win"], "left").select("service", "win", "n", F.coalesce("late", F.lit(0)).alias("late"), F.coalesce("late_value", F.lit(0.0)).alias("late_value"))


#: Coefficients of metrics: slopes of a window's value on the value one or two windows before, within a service and from its parents.
SQL["v_ccoef"] = """WITH v AS (SELECT service||'.'||metric AS node, service, win, value FROM v_cscores), p AS (SELECT parent, target FROM v_flow UNION SELECT DISTINCT service, service FROM v)
 SELECT x.node AS parent, y.node AS target, lag, regr_slope(y.value, x.value) AS coefficient, count(*)>=10 AS ready FROM p JOIN v x ON x.service=p.parent CROSS JOIN (SELECT unnest([1,2]) AS lag) JOIN v y ON y.service=p.target AND y.win=x.win+lag WHERE x.node<>y.node GROUP BY 1,2,3"""
SQL["v_cedges"] = "SELECT parent, target, lag, coefficient, support FROM (SELECT *, coefficient/max(coefficient) OVER () AS support FROM v_ccoef WHERE ready AND coefficient>0 AND NOT isnan(coefficient)) WHERE support>=0.3"
_PATHS = """WITH RECURSIVE t AS (SELECT DISTINCT service||'@'||win AS incident_id, service||'.'||m AS node FROM v_creports CROSS JOIN (SELECT unnest(['request.error_rate', 'request.p99_latency_ms']) AS m)),
 w AS (SELECT service||'@'||win AS incident_id, root_service||'.'||root_metric AS root, root_service||'.'||root_metric AS node, [root_service||'.'||root_metric] AS path, []::INT[] AS lags, root_score/(1+root_score) AS score FROM v_creports WHERE root_score>0
  UNION ALL SELECT incident_id, root, e.target, list_append(path, e.target), list_append(lags, e.lag), score*e.support*exp(-0.1::DOUBLE) FROM w JOIN v_cedges e ON e.parent=w.node WHERE len(lags)<3 AND NOT list_contains(path, e.target))
 SELECT incident_id, root, array_to_string(path, '>') AS path, array_to_string(lags, ',') AS lags, score, len(lags) AS hops, rank FROM (SELECT w.*, row_number() OVER (PARTITION BY incident_id, root ORDER BY score DESC, array_to_string(path, '>'), array_to_string(lags, ',')) AS rank FROM w JOIN t USING (incident_id, node)) WHERE rank<=3"""


def coefficients(v, parents, scores):
    """(parent, target, lag, coefficient, ready) of the metrics of services and of their parents."""
    x = scores.select("service", "win", F.concat_ws(".", "service", "metric").alias("node"), "value")
    pairs = parents.unionByName(x.select(F.col("service").alias("parent"), F.col("service").alias("target"))).distinct()
    before = x.select(F.col("service").alias("parent"), F.col("node").alias("from"), F.col("value").alias("x"), "win", F.explode(F.array(F.lit(1), F.lit(2))).alias("lag")).withColumn("win", F.col("win") + F.col("lag"))
    now = x.select(F.col("service").alias("target"), "node", F.col("value").alias("y"), "win")
    rows = pairs.join(before, "parent").join(now, ["target", "win"]).where("from <> node")
    return rows.groupBy(F.col("from").alias("parent"), F.col("node").alias("target"), "lag").agg(F.regr_slope("y", "x").alias("coefficient"), (F.count("*") >= 10).alias("ready"))


def paths_of(v, out, parents):
    """The best propagation paths from the roots of a chain's reports to the requests of the alerting services."""
    reports = written(out["reports"])
    incident = F.concat_ws("@", "service", F.col("win").cast("string")).alias("incident_id")
    roots = reports.where("root_score > 0").select(incident, F.concat_ws(".", "root_service", "root_metric").alias("root"), (F.col("root_score") / (1 + F.col("root_score"))).alias("support"))
    targets = reports.select(incident, "service").distinct().select("incident_id", F.explode(F.array(*[F.concat_ws(".", "service", F.lit(m)) for m in ("request.error_rate", "request.p99_latency_ms")])).alias("node"))
    edges = written(P.supports(coefficients(v, parents, out["scores"]), 0.3))
    return P.best_paths(roots, edges, targets, 3, 3, 0.1)


SQL["v_paths"] = _PATHS


@query("dia_12_best_paths", "SELECT * FROM v_paths")
def _(v):
    parents, reach = topology(v)
    found = paths_of(v, C.whole(rows(v), parents, reach, RULE), parents)
    return found.select("incident_id", "root", F.concat_ws(">", "path").alias("path"), F.array_join(F.transform("steps", lambda s: s["lag"].cast("string")), ",").alias("lags"), "score", "hops", "rank")
