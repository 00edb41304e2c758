"""The joint system of many incidents as long tables, counterfactuals on it, and independence clusters of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.scalars import noisy_or


def aligned_residuals(actual: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """actual - predicted per key with the reason where either side is missing."""
    j = actual.join(predicted, keys, "full_outer")
    why = F.when(F.col("actual").isNull(), "missing_actual").when(F.col("predicted").isNull(), "missing_prediction").otherwise("ok")
    return j.withColumns({"residual": F.col("actual") - F.col("predicted"), "reason": why})


def normalised_columns(entries: DataFrame, column: list[str]) -> DataFrame:
    """COO entries (row, value) scaled so that each column has length one."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*column)))
    return entries.withColumn("value", F.when(norm > 0, F.col("value") / norm).otherwise(0.0))


def quality_weights(rows: DataFrame, floor: float) -> DataFrame:
    """Row weights: the least quality of what a row rests on, never below the floor."""
    return rows.groupBy("incident_id", "row").agg(F.greatest(F.lit(floor), F.min("quality")).alias("weight"))


def block_penalties(columns: DataFrame, scale: DataFrame, eta: float = 2.0) -> DataFrame:
    """L1 penalty of each column: sigma sqrt(2 ln(n + 1)) over (1 + eta times its evidence)."""
    n = F.count("*").over(Window.partitionBy("incident_id", "block"))
    return columns.withColumn("n", n).join(scale, "incident_id").withColumn("penalty", F.col("sigma") * F.sqrt(2 * F.log(F.col("n") + 1.0)) / (1 + eta * F.col("evidence"))).drop("n", "sigma")


def numbered(rows: DataFrame, group: list[str], within: str) -> DataFrame:
    """Dense numbers of the groups within each incident."""
    return rows.withColumn("group_no", F.dense_rank().over(Window.partitionBy(within).orderBy(*group)) - 1)


def removal_gain(contributions: DataFrame, residual: DataFrame) -> DataFrame:
    """How much the squared error of an incident grows when a candidate's contribution (incident_id, row, candidate, value) is taken away."""
    whole = contributions.groupBy("incident_id", "row").agg(F.sum("value").alias("fit"))
    j = contributions.join(whole, ["incident_id", "row"]).join(residual, ["incident_id", "row"])
    left = F.col("y") - F.col("fit")
    t = j.groupBy("incident_id", "candidate").agg(F.sum((left + F.col("value")) ** 2 - left**2).alias("delta"))
    base = whole.join(residual, ["incident_id", "row"]).groupBy("incident_id").agg(F.sum((F.col("y") - F.col("fit")) ** 2).alias("base"))
    t = t.join(base, "incident_id").withColumn("relative", F.col("delta") / (F.col("base") + 1e-9)).drop("base")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("delta"), "candidate")))


def independence_clusters(evidence: DataFrame, rounds: int = 20) -> DataFrame:
    """(target, item, cluster): evidence of a target that shares a channel or a source is one cluster.

    Least labels travel over shared channels and sources until nothing changes; each round is two grouped minima.
    """
    links = evidence.select("target", "item", F.explode(F.array(F.concat(F.lit("c:"), "channel"), F.concat(F.lit("s:"), "source"))).alias("via")).distinct()
    labels = evidence.select("target", "item", F.col("item").alias("cluster")).distinct()
    for _ in range(rounds):
        near = links.join(labels, ["target", "item"]).groupBy("target", "via").agg(F.min("cluster").alias("least"))
        fresh = links.join(near, ["target", "via"]).groupBy("target", "item").agg(F.min("least").alias("cluster")).checkpoint()
        changed = fresh.join(labels.withColumnRenamed("cluster", "old"), ["target", "item"]).where("cluster <> old").isEmpty()
        labels = fresh
        if changed:
            break
    return labels


def independent_strength(evidence: DataFrame, clusters: DataFrame) -> DataFrame:
    """Largest strength of each cluster, noisy-or over the clusters of a target."""
    best = evidence.join(clusters, ["target", "item"]).groupBy("target", "cluster").agg(F.max("strength").alias("s"))
    return best.groupBy("target").agg(noisy_or(F.collect_list("s")).alias("strength"), F.count("*").alias("clusters"))
