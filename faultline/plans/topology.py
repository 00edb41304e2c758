"""Queries for topology and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators import topology as T

from .alerts import numbered, windows
from .baselines import scored
from .views import SQL, query

SQL["v_both"] = "SELECT src, dst FROM v_graph UNION SELECT dst, src FROM v_graph"
SQL["v_members"] = "SELECT DISTINCT service, node FROM v_placement"


def hop_sql(seed: str, edges: str, most: int, extra: str = "") -> str:
    """Nodes within so many hops of the seeds, least hop."""
    return f"WITH RECURSIVE w AS (SELECT DISTINCT {extra}seed, seed AS node, 0 AS hop FROM ({seed}) UNION SELECT {extra}seed, e.dst, hop+1 FROM w JOIN {edges} e ON e.src=w.node WHERE hop<{most}) SELECT {extra}seed, node, min(hop) AS hop FROM w GROUP BY ALL"


def services(v):
    return v.graph().where("edge_type = 'call'").select(F.col("src").alias("seed")).distinct()


_SEED = "SELECT DISTINCT src AS seed FROM v_graph WHERE edge_type='call'"


@query("top_01_point_in_time", "SELECT o.o_orderkey AS q, o_orderdate_s AS ts, s.snapshot_id, CASE WHEN s.snapshot_id IS NULL THEN 'no_snapshot' END AS issue FROM (SELECT o_orderkey, epoch(date_trunc('day', o_orderdate)) AS o_orderdate_s FROM orders) o LEFT JOIN (SELECT DISTINCT snapshot_id, valid_from, valid_to FROM v_snapshots) s ON o_orderdate_s>=valid_from AND o_orderdate_s<valid_to")
def _(v):
    q = v.table("orders").select(F.col("o_orderkey").alias("q"), (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) * 86400.0).alias("ts"))
    return T.point_in_time(q, v.snapshots(), "ts")


@query("top_02_overlaps", "SELECT snapshot_id, coalesce(max(valid_to) OVER (ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > valid_from, false) AS overlaps FROM (SELECT DISTINCT snapshot_id, valid_from, valid_to FROM v_snapshots)")
def _(v):
    return T.overlapping(v.snapshots().select("snapshot_id", "valid_from", "valid_to").distinct()).select("snapshot_id", "overlaps")


@query("top_03_resolve_endpoint", "SELECT service, CASE WHEN count(*)=1 THEN min(node) END AS resolved, CASE WHEN count(*)>1 THEN 'ambiguous' END AS issue FROM v_members GROUP BY 1")
def _(v):
    t = v.placement().distinct().groupBy("service").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return t.select("service", F.when(F.col("n") == 1, F.col("node")).alias("resolved"), F.when(F.col("n") > 1, "ambiguous").alias("issue"))


@query("top_04_call_groups", "SELECT src, dst, array_to_string(list_sort(list(DISTINCT edge_type)), ',') AS kinds, count(*) AS n FROM v_graph GROUP BY 1,2")
def _(v):
    return v.graph().groupBy("src", "dst").agg(F.concat_ws(",", F.sort_array(F.collect_set("edge_type"))).alias("kinds"), F.count("*").alias("n"))


@query("top_05_impact_edges", "WITH x AS (SELECT src, dst FROM v_graph WHERE edge_type='call' AND src<dst), d AS (SELECT dst AS src, src AS dst FROM v_graph WHERE edge_type='call' UNION SELECT src, dst FROM v_graph WHERE edge_type='trace' UNION SELECT dst, src FROM v_graph WHERE edge_type='trace') SELECT src, dst, 'explicit' AS origin FROM x UNION ALL SELECT src, dst, 'rule' FROM d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.src=d.src AND x.dst=d.dst)")
def _(v):
    rules = v.spark.createDataFrame([("call", "reverse"), ("trace", "both")], "edge_type string, direction string")
    g = v.graph()
    return T.impact_edges(g, g.where("edge_type = 'call' and src < dst"), rules)


@query("top_06_cohost_pairs", "SELECT a.service AS a, b.service AS b, count(*) AS shared FROM v_members a JOIN v_members b ON a.node=b.node AND a.service<b.service GROUP BY 1,2")
def _(v):
    return T.pairs_sharing(v.placement(), "service", "node")


@query("top_07_shared_resources", "SELECT a.dst AS a, b.dst AS b, count(*) AS shared FROM (SELECT DISTINCT src, dst FROM v_graph) a JOIN (SELECT DISTINCT src, dst FROM v_graph) b ON a.src=b.src AND a.dst<b.dst GROUP BY 1,2")
def _(v):
    return T.pairs_sharing(v.graph(), "dst", "src")


@query("top_08_service_graph", "SELECT service, mode, count(*) AS neighbours FROM (SELECT DISTINCT src AS service, dst, 'directed' AS mode FROM v_graph UNION ALL SELECT DISTINCT dst, src, 'reverse' FROM v_graph UNION ALL SELECT src, dst, 'undirected' FROM v_both) GROUP BY 1,2")
def _(v):
    g = v.graph().select("src", "dst").distinct()
    rev = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    modes = g.withColumn("mode", F.lit("directed")).unionByName(rev.withColumn("mode", F.lit("reverse"))).unionByName(T.both_ways(g).withColumn("mode", F.lit("undirected")))
    return modes.groupBy(F.col("src").alias("service"), "mode").agg(F.count("*").alias("neighbours"))


@query("top_09_allowed_graph", "SELECT src, dst FROM v_both UNION SELECT a.service, b.service FROM v_members a JOIN v_members b ON a.node=b.node AND a.service<>b.service")
def _(v):
    return T.both_ways(v.graph()).unionByName(T.both_ways(T.pairs_sharing(v.placement(), "service", "node").select(F.col("a").alias("src"), F.col("b").alias("dst")))).distinct()


@query("can_01_neighbourhood", f"SELECT seed, node, min(hop) AS hop, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT *, 'downstream' AS label FROM ({hop_sql(_SEED, 'v_graph', 2)}) UNION ALL SELECT *, 'upstream' FROM ({hop_sql(_SEED, '(SELECT dst AS src, src AS dst FROM v_graph)', 3)})) GROUP BY 1,2")
def _(v):
    g = v.graph().select("src", "dst")
    down = T.hops(services(v), g, 2).withColumn("label", F.lit("downstream"))
    up = T.hops(services(v), g.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 3).withColumn("label", F.lit("upstream"))
    return down.unionByName(up).groupBy("seed", "node").agg(F.min("hop").alias("hop"), F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("labels"))


@query("can_02_resource_neighbours", "SELECT a, count(*) AS neighbours, max(shared) AS most FROM (SELECT a.service AS a, b.service AS b, count(*) AS shared FROM v_members a JOIN v_members b ON a.node=b.node AND a.service<>b.service GROUP BY 1,2) GROUP BY 1")
def _(v):
    p = T.pairs_sharing(v.placement(), "service", "node")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    return both.groupBy("a").agg(F.count("*").alias("neighbours"), F.max("shared").alias("most"))


@query("can_03_candidate_nodes", "SELECT DISTINCT node_id, service FROM v_panel WHERE service IN (SELECT dst FROM v_graph WHERE src='svc0' UNION SELECT 'svc0') AND metric NOT LIKE 'request.%'")
def _(v):
    near = T.hops(services(v).where("seed = 'svc0'"), v.graph(), 1).select(F.col("node").alias("service"))
    nodes = v.panel().where(S.metric_family(F.col("metric")) != "load").select("node_id", "service").distinct()
    return nodes.join(near, "service", "left_semi")


_SYM = "SELECT window_no, service AS seed FROM (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY votes DESC, z DESC, sc DESC, service) AS r FROM (SELECT window_no, service, count(*) AS votes, max(z_score) AS z, max(alert_score) AS sc FROM v_numbered GROUP BY 1,2)) WHERE r=1"


def window_candidates(v):
    from faultline.operators.alerts import symptom_vote

    seeds = symptom_vote(numbered(v)).select("window_no", F.col("symptom_service").alias("seed"))
    return T.hops(seeds, T.both_ways(v.graph()), 2, ["window_no"])


@query("can_04_window_candidates", f"SELECT window_no, seed, count(*) AS services, max(hop) AS far FROM ({hop_sql(_SYM, 'v_both', 2, 'window_no, ')}) GROUP BY 1,2")
def _(v):
    return window_candidates(v).groupBy("window_no", "seed").agg(F.count("*").alias("services"), F.max("hop").alias("far"))


@query("can_05_provenance", "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM v_graph WHERE edge_type='call'), w AS (SELECT src AS seed, src AS node, [src] AS path, 0 AS hop FROM e UNION SELECT seed, e.dst, list_append(path, e.dst), hop+1 FROM w JOIN e ON e.src=w.node WHERE hop<4 AND NOT list_contains(path, e.dst)) SELECT seed, node, hop, array_to_string(path, '>') AS path FROM w WHERE hop>0")
def _(v):
    p = T.simple_paths(services(v), v.graph().where("edge_type = 'call'").select("src", "dst", "weight"), 4)
    return p.select("seed", "node", (F.size("path") - 1).alias("hop"), F.concat_ws(">", "path").alias("path"))


@query("can_06_stale_triggers", "SELECT DISTINCT service FROM v_members WHERE service NOT IN (SELECT src FROM v_graph UNION SELECT dst FROM v_graph)")
def _(v):
    known = v.graph().select(F.explode(F.array("src", "dst")).alias("service"))
    return v.placement().select("service").distinct().join(known, "service", "left_anti")


@query("can_07_bounded_bfs", hop_sql("SELECT DISTINCT src AS seed FROM v_graph", "v_graph", 3))
def _(v):
    return T.hops(v.graph().select(F.col("src").alias("seed")).distinct(), v.graph().select("src", "dst"), 3)


@query("can_08_provenance_cap", "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS r FROM v_graph) WHERE r<=2")
def _(v):
    return T.capped(v.graph(), ["dst"], [F.desc("weight"), F.col("src")], 2)[0].select("src", "dst", "weight")


@query("can_09_observed_missing", "SELECT service, count(*) FILTER (seen) AS observed, count(*) FILTER (NOT seen) AS missing FROM (SELECT s.service, m.metric, EXISTS (SELECT 1 FROM v_metrics x WHERE x.service=s.service AND x.metric=m.metric AND x.timestamp<1704153600) AS seen FROM (SELECT DISTINCT service FROM v_metrics) s CROSS JOIN (SELECT DISTINCT metric FROM v_metrics) m) GROUP BY 1")
def _(v):
    m = v.metrics()
    want = m.select("service").distinct().join(F.broadcast(m.select("metric").distinct()))  # the five metric names
    have = m.where("timestamp < 1704153600").select("service", "metric").distinct().withColumn("seen", F.lit(True))
    t = want.join(have, ["service", "metric"], "left")
    return t.groupBy("service").agg(F.count("seen").alias("observed"), (F.count("*") - F.count("seen")).alias("missing"))


@query("can_10_topology_changed", "SELECT window_no, year, year <> coalesce(lag(year) OVER (ORDER BY window_no), year) AS changed FROM (SELECT window_no, 'd'||CAST(floor(start_ts/864000) AS BIGINT) AS year FROM v_windows)")
def _(v):
    w = windows(v).select("window_no", F.concat(F.lit("d"), F.floor(F.col("start_ts") / 864000).cast("string")).alias("year"))
    before = F.lag("year").over(Window.partitionBy(F.lit(0)).orderBy("window_no"))
    return w.withColumn("changed", F.col("year") != F.coalesce(before, F.col("year")))


@query("can_11_strong_candidates", hop_sql("SELECT DISTINCT src AS seed FROM v_graph", "(SELECT * FROM v_graph WHERE weight>=0.03)", 2))
def _(v):
    return T.hops(v.graph().select(F.col("src").alias("seed")).distinct(), v.graph().where("weight >= 0.03").select("src", "dst"), 2)


@query("can_12_coverage_check", f"WITH c AS ({hop_sql(_SEED, 'v_both', 2)}) SELECT incident_id, bool_or(node=root_service) AS covered, count(*) AS candidates FROM v_incidents i JOIN c ON c.seed=i.symptom_service GROUP BY 1")
def _(v):
    c = T.hops(services(v), T.both_ways(v.graph()), 2)
    j = v.incidents().join(c, F.col("seed") == F.col("symptom_service"))
    return j.groupBy("incident_id").agg(F.bool_or(F.col("node") == F.col("root_service")).alias("covered"), F.count("*").alias("candidates"))


@query("can_13_centrality", "WITH d AS (SELECT service, count(*) AS degree FROM (SELECT src AS service FROM v_graph UNION ALL SELECT dst FROM v_graph) GROUP BY 1) SELECT service, degree, degree/(SELECT max(degree) FROM d) AS centrality FROM d")
def _(v):
    return T.centrality(v.graph())
