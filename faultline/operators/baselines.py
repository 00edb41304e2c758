"""Healthy baselines and robust anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAD = 1.4826


def median_mad(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, median and mad of a column: exact, in two aggregations."""
    center = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, 0.5).alias("median"))
    spread = rows.join(center, keys).groupBy(*keys, "n", "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return spread


def incident_ranges(incidents: DataFrame, first: Column | float) -> DataFrame:
    """incidents plus from_ts: each owns [end of the one before, its end); the first from ``first``. A small table."""
    w = Window.partitionBy(F.lit(0)).orderBy("start_ts")
    start = first if isinstance(first, Column) else F.lit(first)
    return incidents.withColumn("from_ts", F.coalesce(F.lag("end_ts").over(w), start))


def robust_stats(metrics: DataFrame, incidents: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Median and MAD per (incident, service, instance, metric) before the incident.

    Falls back from rows without an incident id of the instance to any of the instance, then
    the same two of (service, metric). Both kinds of rows are taken in the same two aggregations of each level. The incident
    table is small and broadcast by size.
    """
    before = metrics.join(incidents.select(F.col("incident_id").alias("incident"), "start_ts"), F.col("timestamp") < F.col("start_ts"))
    kinds = {"clean": F.col("incident_id").isNull(), "any": F.lit(True)}
    out = metrics.select("service", "instance", "metric").distinct().join(incidents.select(F.col("incident_id").alias("incident")))
    choices = []
    for keys in (["incident", "service", "instance", "metric"], ["incident", "service", "metric"]):
        of = lambda k, x: F.when(kinds[k], x)
        size = len(keys)
        parts = [(F.count(of(k, F.lit(1))).alias(f"rows_{k}"), F.count(of(k, F.col("value"))).alias(f"n_{k}"), F.percentile(of(k, F.col("value")), 0.5).alias(f"median_{k}")) for k in kinds]
        center = before.groupBy(*keys).agg(*[c for part in parts for c in part])
        mads = [F.percentile(of(k, F.abs(F.col("value") - F.col(f"median_{k}"))), 0.5).alias(f"mad_{k}") for k in kinds]
        both = before.join(center, keys).groupBy(*keys, *center.columns[size:]).agg(*mads)
        stats = [F.when(F.col(f"rows_{k}") > 0, F.struct(F.col(f"median_{k}").alias("median"), F.col(f"mad_{k}").alias("mad"), F.col(f"n_{k}").alias("n"))).alias(f"{k}_{size}") for k in kinds]
        out = out.join(both.select(*keys, *stats), keys, "left")
        choices += [f"{k}_{size}" for k in kinds]
    best = out.withColumn("s", F.coalesce(*choices)).where("s is not null")
    return best.select("incident", "service", "instance", "metric", "s.median", "s.mad", (MAD * F.col("s.mad") + eps).alias("scale"), F.col("s.n").alias("baseline_count"))


def normalise(metrics: DataFrame, incidents: DataFrame, eps: float = 1e-6, clip: float | None = 20.0) -> DataFrame:
    """Rows of each incident's range with their clipped robust z."""
    first = metrics.agg(F.min("timestamp").alias("first_ts"))
    ranges = incident_ranges(incidents.join(first), F.col("first_ts")).select(F.col("incident_id").alias("incident"), "from_ts", "end_ts")
    inside = metrics.join(ranges, (F.col("timestamp") >= F.col("from_ts")) & (F.col("timestamp") < F.col("end_ts")))
    z = (F.col("value") - F.col("median")) / F.col("scale")
    if clip is not None:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return inside.join(robust_stats(metrics, incidents, eps), ["incident", "service", "instance", "metric"]).withColumn("z_value", z)


def prefix_z(rows: DataFrame, keys: list[str], order: list[str], ratio: float = 0.3, least: int = 3, eps: float = 1e-9) -> DataFrame:
    """rows plus z_score against the first ``ratio`` (``least`` rows at least) of each series; shorter series go."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"r": F.row_number().over(w.orderBy(*order)), "cnt": F.count("*").over(w)}).where(F.col("cnt") >= least)
    base = ranked.where(F.col("r") <= F.greatest(F.lit(least), F.ceil(F.col("cnt") * ratio)))
    stats = median_mad(base, keys).select(*keys, "median", "mad")
    return ranked.join(stats, keys).withColumn("z_score", (F.col("value") - F.col("median")) / (MAD * F.col("mad") + eps)).drop("r", "cnt", "median", "mad")


def before_alert_z(panel: DataFrame, first_alert: Column | float, keys: list[str], least: int = 3, ratio: float = 0.3, scale_floor: float = 1e-6) -> DataFrame:
    """z against the points before the first alert; too few of them: against the first share; none: against the whole series."""
    at = first_alert if isinstance(first_alert, Column) else F.lit(first_alert)
    w = Window.partitionBy(*keys)
    ranked = panel.withColumns({"r": F.row_number().over(w.orderBy("ts")), "cnt": F.count("*").over(w), "early": F.sum((F.col("ts") < at).cast("int")).over(w)})
    share = F.greatest(F.lit(1), F.ceil(F.col("cnt") * ratio))
    mode = F.when(F.col("early") >= least, "before_alert").when(F.col("cnt") >= least, "prefix").otherwise("all")
    ranked = ranked.withColumn("baseline", mode)
    inside = F.when(F.col("baseline") == "before_alert", F.col("ts") < at).when(F.col("baseline") == "prefix", F.col("r") <= share).otherwise(True)
    stats = median_mad(ranked.where(inside), keys).select(*keys, "median", "mad")
    return ranked.join(stats, keys).withColumn("z", (F.col("value") - F.col("median")) / F.greatest(MAD * F.col("mad"), F.lit(scale_floor))).drop("r", "cnt", "early", "median", "mad")


def healthy_frame(rows: DataFrame, keys: list[str], order: list[str], size: int, healthy: Column) -> DataFrame:
    """rows plus count, median and MAD of the last ``size`` healthy values before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = F.slice(F.reverse(F.collect_list(F.when(healthy, F.col("value"))).over(w)), 1, size)
    mid = lambda a: F.when(F.size(a) % 2 == 1, F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))).otherwise(
        (F.get(F.array_sort(a), (F.size(a) / 2).cast("int") - 1) + F.get(F.array_sort(a), (F.size(a) / 2).cast("int"))) / 2
    )
    held = rows.withColumn("held", kept).withColumn("median", mid(F.col("held")))
    away = F.transform("held", lambda x: F.abs(x - F.col("median")))
    return held.withColumn("mad", mid(away)).withColumn("n_held", F.size("held")).drop("held")


def rolling_score(framed: DataFrame, least: int, floor: float, cap: float, polarity: int = 1) -> DataFrame:
    """Score of each row against its frame: capped positive z; not ready below ``least`` values."""
    z = polarity * (F.col("value") - F.col("median")) / F.greatest(MAD * F.col("mad"), F.lit(floor))
    ready = F.col("n_held") >= least
    score = F.when(ready, F.least(F.greatest(z, F.lit(0.0)), F.lit(cap)))
    return framed.withColumns({"ready": ready, "score": score, "issue": F.when(~ready, "baseline_not_ready")})


def scale_choice(rows: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Scale per key: MAD if at least the floor, else inter-quartile range / 1.349, else the floor; and its source."""
    stats = median_mad(rows, keys).join(rows.groupBy(*keys).agg(F.percentile("value", [0.25, 0.75]).alias("q")), keys)
    mad, iqr = MAD * F.col("mad"), (F.col("q")[1] - F.col("q")[0]) / 1.349
    return stats.select(*keys, "n", "median", F.when(mad >= floor, mad).when(iqr >= floor, iqr).otherwise(floor).alias("scale"), F.when(mad >= floor, "mad").when(iqr >= floor, "iqr").otherwise("floor").alias("scale_source"))


def readiness(rows: DataFrame, keys: list[str], least: int, floor: float) -> DataFrame:
    """Status of each baseline: ready or why not."""
    s = scale_choice(rows, keys, floor)
    reason = F.when(F.col("n") < least, "too_few_samples").when(F.col("scale_source") == "floor", "scale_at_floor").otherwise("ready")
    return s.select(*keys, "n", (F.col("n") >= least).alias("ready"), reason.alias("reason"))


def continuous_strength(healthy: DataFrame, rows: DataFrame, keys: list[str], z_cap: float, least_samples: int, least_scale: float, polarity: int = 1) -> DataFrame:
    """Strength 0..1 of each row: capped z against healthy rows of its key; too few of those: 0."""
    s = median_mad(healthy, keys)
    z = polarity * (F.col("value") - F.col("median")) / F.greatest(MAD * F.col("mad"), F.lit(least_scale))
    return rows.join(s, keys).withColumn("strength", F.when(F.col("n") < least_samples, 0.0).otherwise(F.greatest(F.least(z, F.lit(z_cap)), F.lit(0.0)) / z_cap))


def family_scores(scores: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Service state: the largest score of each family, summed by weight; missing families count nothing."""
    best = scores.groupBy(*keys, "family").agg(F.max("score").alias("score"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("family")], F.lit(0.0))
    return best.groupBy(*keys).agg(F.sum(weight * F.col("score")).alias("service_score"), F.count("*").alias("families"))


def symptom_scores(wide: DataFrame, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """alpha * latency + beta * failure per row; rows with neither go."""
    score = alpha * F.coalesce("latency", F.lit(0.0)) + beta * F.coalesce("failure", F.lit(0.0))
    return wide.where("latency is not null or failure is not null").withColumn("symptom_score", score)


def resolve_roles(records: DataFrame, roles: DataFrame, on: list[str]) -> DataFrame:
    """records with their role; none or several matching roles become an issue. The role table is a fixed small dimension."""
    found = roles.groupBy(*on).agg(F.count("*").alias("matches"), F.min("role").alias("role"))
    issue = F.when(F.col("matches").isNull(), "no_role").when(F.col("matches") > 1, "several_roles")
    return records.join(found, on, "left").withColumn("issue", issue).withColumn("role", F.when(F.col("matches") == 1, F.col("role"))).drop("matches")


def healthy_history(rows: DataFrame, state: Column, quality: Column, least_quality: float, frozen: DataFrame, key: str) -> DataFrame:
    """rows with accept or the first reason against learning from them."""
    marked = rows.join(frozen.select(key).distinct().withColumn("frozen", F.lit(True)), key, "left")
    reason = F.when(state != "healthy", "not_healthy").when(quality < least_quality, "low_quality").when(F.col("frozen"), "frozen").otherwise("accepted")
    return marked.withColumn("decision", reason).drop("frozen")
