"""The best propagation paths of each root: bounded search with exact pruning, two table scans a hop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators.tables import written


def supports(coefficients: DataFrame, least: float) -> DataFrame:
    """(parent, target, lag, coefficient, support) of ready positive coefficients (parent, target, lag, coefficient, ready): their share of the largest, ``least`` at least."""
    positive = coefficients.where("ready and coefficient > 0 and not isnan(coefficient)")
    top = positive.agg(F.max("coefficient").alias("top"))
    shares = positive.join(F.broadcast(top)).withColumn("support", F.col("coefficient") / F.col("top"))
    return shares.where(F.col("support") >= least).select("parent", "target", "lag", "coefficient", "support")


def promising(edges: DataFrame, targets: DataFrame, most: int, decay: float) -> DataFrame:
    """Edges from which a target of the incident is within reach: (incident_id, parent, target, lag, coefficient, support, ends, promise).

    promise[r] is the largest factor that any walk of up to r further edges from the edge's end to a target can have; ends
    tells whether the edge's end is a target itself.
    """
    hop = edges.groupBy("parent", "target").agg(F.max("support").alias("s"))
    reach = written(targets.select("incident_id", "node").distinct().withColumn("g", F.array(F.lit(1.0))))
    for _ in range(most - 1):
        back = reach.join(hop, F.col("node") == F.col("target")).select("incident_id", F.col("parent").alias("node"), (F.element_at("g", -1) * F.col("s") * decay).alias("v"), F.size("g").alias("n"))
        step = back.groupBy("incident_id", "node").agg(F.max("v").alias("v"), F.max("n").alias("n"))
        both = reach.join(step, ["incident_id", "node"], "full")
        longer = F.coalesce(reach["g"], F.array_repeat(F.lit(0.0), step["n"]))
        last = F.greatest(F.element_at(longer, -1), F.coalesce("v", F.lit(0.0)))
        reach = written(both.select("incident_id", "node", F.concat(longer, F.array(last)).alias("g")))
    is_target = targets.select("incident_id", F.col("node").alias("target"), F.lit(True).alias("ends")).distinct()
    joined = edges.join(reach.select("incident_id", F.col("node").alias("target"), F.col("g").alias("promise")), "target").join(is_target, ["incident_id", "target"], "left")
    return joined.withColumn("ends", F.coalesce("ends", F.lit(False)))


def best_paths(roots: DataFrame, edges: DataFrame, targets: DataFrame, most: int, keep: int, penalty: float) -> DataFrame:
    """The ``keep`` best paths of each root (incident_id, root, support) to a target (incident_id, node) over up to ``most`` edges.

    No node comes twice. A path's score is the root's support (0 to 1) times the supports of its edges times exp(-penalty) for
    each edge, so it only falls as a path grows. A path is left as soon as even its best continuation, walks with repeats
    included, is below the ``keep`` best complete paths found; what is left is exactly what all paths, sorted, would give.
    Equal scores are ordered by their nodes, then lags. (incident_id, root, path, steps, score, hops, rank)
    """
    decay = F.lit(math.exp(-penalty))
    e = written(promising(edges, targets, most, math.exp(-penalty)))
    step = "array<struct<lag:int,coefficient:double,support:double>>"
    at_target = targets.select("incident_id", F.col("node").alias("root"), F.lit(True).alias("hit")).distinct()
    start = roots.withColumn("score", F.least(F.greatest("support", F.lit(0.0)), F.lit(1.0))).where("score > 0")
    base = start.join(at_target, ["incident_id", "root"], "left").select("incident_id", "root", F.col("root").alias("node"), F.array("root").alias("path"), F.array().cast(step).alias("steps"), "score", F.coalesce("hit", F.lit(False)).alias("hit"))
    rows = written(base.select("*", F.explode(F.when(F.col("hit"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("done")).drop("hit"))
    by = Window.partitionBy("incident_id", "root")
    order = [F.desc("score"), F.concat_ws(">", "path"), F.to_json("steps.lag")]
    ranked = F.row_number().over(Window.partitionBy("incident_id", "root", "done").orderBy(*order))
    for hop in range(1, most + 1):
        cut = rows.join(e, (rows["incident_id"] == e["incident_id"]) & (rows["node"] == e["parent"]) & ~rows["done"], "left")
        fresh = ~F.col("done") & e["parent"].isNotNull() & ~F.array_contains("path", e["target"])
        state = F.struct(
            e["target"].alias("node"), F.concat("path", F.array(e["target"])).alias("path"), F.concat("steps", F.array(F.struct("lag", "coefficient", e["support"]).cast(step[6:-1]))).alias("steps"),
            (F.col("score") * e["support"] * decay).alias("score"), F.get("promise", F.lit(most - hop)).alias("promise"),
        )
        new = F.array_compact(F.array(F.when(fresh, F.struct(state["node"].alias("node"), state["path"].alias("path"), state["steps"].alias("steps"), state["score"].alias("score"), state["promise"].alias("promise"), F.lit(False).alias("done"))), F.when(fresh & F.col("ends"), F.struct(state["node"].alias("node"), state["path"].alias("path"), state["steps"].alias("steps"), state["score"].alias("score"), F.lit(0.0).alias("promise"), F.lit(True).alias("done")))))
        old = F.array(F.struct("node", "path", "steps", "score", F.lit(0.0).alias("promise"), "done"))
        out = cut.select(rows["incident_id"], "root", F.explode(F.when(F.col("done"), old).otherwise(new)).alias("x")).select("incident_id", "root", "x.*")
        placed = out.withColumn("r", ranked)
        bound = F.min(F.when(F.col("done") & (F.col("r") == keep), F.col("score"))).over(by)
        alive = placed.withColumn("bound", bound).where((F.col("done") & (F.col("r") <= keep)) | (~F.col("done") & (F.col("bound").isNull() | (F.col("score") * F.col("promise") * (1 + 1e-12) >= F.col("bound")))))
        rows = written(alive.select("incident_id", "root", "node", "path", "steps", "score", "done"))
    last = rows.where("done").withColumn("rank", F.row_number().over(by.orderBy(*order))).where(F.col("rank") <= keep)
    return last.select("incident_id", "root", "path", "steps", "score", F.size("steps").alias("hops"), "rank")
