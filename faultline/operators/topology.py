"""Topology snapshots, service graphs and candidate sub-graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators.tables import written


def point_in_time(queries: DataFrame, snapshots: DataFrame, ts: str, bucket: float = 86400.0 * 366) -> DataFrame:
    """The snapshot valid at each ts, [from, to): found by time cells; none or several are an issue."""
    cells = F.sequence(F.floor(F.col("valid_from") / bucket), F.floor(F.col("valid_to") / bucket))
    s = snapshots.select("snapshot_id", "valid_from", "valid_to").distinct().withColumn("cell", F.explode(cells))
    hit = queries.withColumn("cell", F.floor(F.col(ts) / bucket)).join(s, "cell").where((F.col(ts) >= F.col("valid_from")) & (F.col(ts) < F.col("valid_to")))
    t = hit.groupBy(*queries.columns).agg(F.count_distinct("snapshot_id").alias("matches"), F.min("snapshot_id").alias("snapshot_id"))
    back = queries.join(t, queries.columns, "left").withColumn("issue", F.when(F.col("matches").isNull(), "no_snapshot").when(F.col("matches") > 1, "several_snapshots"))
    return back.drop("matches")


def overlapping(snapshots: DataFrame) -> DataFrame:
    """Snapshots that begin before an earlier one has ended."""
    w = Window.partitionBy(F.lit(0)).orderBy("valid_from", "valid_to").rowsBetween(Window.unboundedPreceding, -1)
    return snapshots.withColumn("overlaps", F.coalesce(F.max("valid_to").over(w) > F.col("valid_from"), F.lit(False)))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def pairs_sharing(members: DataFrame, item: str, holder: str) -> DataFrame:
    """Pairs (a < b) of items with a holder in common, with the number of holders."""
    a, b = members.select(F.col(item).alias("a"), holder).distinct(), members.select(F.col(item).alias("b"), holder).distinct()
    return a.join(b, holder).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def impact_edges(calls: DataFrame, explicit: DataFrame, rules: DataFrame) -> DataFrame:
    """Explicit impact edges, and for the others what the rule of the call's type derives: callee to caller, caller to callee, both."""
    ways = F.when(F.col("direction") == "both", F.array(F.lit("forward"), F.lit("reverse"))).when(F.col("direction") == "none", F.array().cast("array<string>")).otherwise(F.array("direction"))
    made = calls.join(rules, "edge_type").select("src", "dst", F.explode(ways).alias("way"))
    derived = made.select(F.when(F.col("way") == "forward", F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(F.col("way") == "forward", F.col("dst")).otherwise(F.col("src")).alias("dst")).distinct()
    return explicit.select("src", "dst", F.lit("explicit").alias("origin")).unionByName(derived.join(explicit, ["src", "dst"], "left_anti").withColumn("origin", F.lit("rule")))


def hops(seeds: DataFrame, edges: DataFrame, most: int, keep: list[str] | None = None) -> DataFrame:
    """(keep..., seed, node, hop): nodes within ``most`` edges of each seed and their least hop.

    One join a hop, each frontier deduplicated and written, so that a hop reads edges and frontiers and plans nothing again.
    """
    keys = [*(keep or []), "seed"]
    edges = written(edges.select("src", "dst"))
    seen = written(seeds.select(*keys, F.col("seed").alias("node"), F.lit(0).alias("hop")))
    front = seen
    for hop in range(1, most + 1):
        step = front.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select(*keys, F.col("next").alias("node"), F.lit(hop).alias("hop")).distinct()
        front = written(step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def simple_paths(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(seed, node, path, score) of all paths without repeated nodes up to ``most`` edges; score is the product of weights."""
    step = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "weight"))
    front = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"), F.lit(1.0).alias("score"))
    out = None
    for _ in range(most):
        joined = front.join(step, "node").where(~F.array_contains("path", F.col("next")))
        front = written(joined.select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), (F.col("score") * F.col("weight")).alias("score")))
        out = front if out is None else out.unionByName(front)
    return out


def centrality(edges: DataFrame) -> DataFrame:
    """Degree of each node over the largest."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("service")).groupBy("service").agg(F.count("*").alias("degree"))
    return degree.join(degree.agg(F.max("degree").alias("top"))).select("service", "degree", (F.col("degree") / F.col("top")).alias("centrality"))


def capped(rows: DataFrame, group: list[str], order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each group, and how many each group has beyond."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    over = rows.groupBy(*group).agg((F.count("*") - most).alias("overflow")).where("overflow > 0")
    return ranked.where(F.col("r") <= most).drop("r"), over
