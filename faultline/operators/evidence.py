"""Observation policy and evidence scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.scalars import evidence_type, noisy_or, root_type, specificity
from faultline.operators.alerts import streaks
from faultline.operators.tables import written

ALWAYS_ON = ("request.error_rate", "request.p99_latency_ms")


def observation_mode(rows: DataFrame, alert: DataFrame, soft: float = 3.0, hard: float = 6.0, need: int = 2) -> DataFrame:
    """mode and probability of each row (window, service, metric) from its service's alert z (window, service, alert_z) and hard streak."""
    run = streaks(alert, ["service"], ["window"], F.col("alert_z") >= hard)
    j = rows.join(run.select("window", "service", "alert_z", "streak"), ["window", "service"], "left")
    z, s = F.coalesce("alert_z", F.lit(0.0)), F.coalesce("streak", F.lit(0))
    mode = F.when(F.col("metric").isin(*ALWAYS_ON), "always_on").when(s >= need, "hard_alert_burst").when(z >= soft, "soft_alert_burst").otherwise("normal_sampled")
    p = F.when(F.col("mode") == "always_on", 1.0).when(F.col("mode") == "hard_alert_burst", 1.0).when(F.col("mode") == "soft_alert_burst", 0.4).otherwise(0.1)
    return j.withColumn("mode", mode).withColumn("probability", p).drop("alert_z", "streak")


def draw(key: Column, seed: int = 7) -> Column:
    """A uniform draw in [0, 1) that depends on the key alone, so partitions and reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled(rows: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """rows plus observed: a Bernoulli draw at each row's probability."""
    return rows.withColumn("observed", draw(F.col(key), seed) < F.col("probability"))


def probe_gain(rows: DataFrame) -> DataFrame:
    """gain and probability of each probe (severity, intensity, evidence, centrality, missing, cost)."""
    g = 0.3 * F.col("severity") + 0.2 * F.col("intensity") + 0.2 * F.col("evidence") + 0.15 * F.col("centrality") + 0.15 * F.col("missing") - 0.1 * F.col("cost")
    return rows.withColumn("gain", g).withColumn("probability", 1 / (1 + F.exp(-4 * F.col("gain"))))


def within_budget(rows: DataFrame, window: str, budget: float) -> DataFrame:
    """(window, probe): greedy choice by gain over cost, skipping what no longer fits. An ordered fold over the few probes of a window."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("gain") / F.col("cost")).alias("k"), F.col("probe").alias("probe"), F.col("cost").alias("cost"))))
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<string>").alias("chosen"))
    step = lambda acc, x: F.struct(
        F.when(acc["spent"] + x["cost"] <= budget, acc["spent"] + x["cost"]).otherwise(acc["spent"]).alias("spent"),
        F.when(acc["spent"] + x["cost"] <= budget, F.concat(acc["chosen"], F.array(x["probe"]))).otherwise(acc["chosen"]).alias("chosen"),
    )
    t = rows.groupBy(window).agg(ordered.alias("_rows")).select(window, F.aggregate("_rows", start, step).alias("r"))
    return t.select(window, F.col("r.spent").alias("spent"), F.explode("r.chosen").alias("probe"))


def blind_lift(metrics: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Lift of each (window, service, metric) between before its start and inside it, both ends included; needs both sides."""
    w = windows.select(key, "start_ts", "end_ts")
    j = metrics.select("service", "metric", "timestamp", "value").join(w, F.col("timestamp") <= F.col("end_ts"))
    side = lambda test: F.avg(F.when(test, F.col("value")))
    t = j.groupBy(key, "service", "metric").agg(side(F.col("timestamp") < F.col("start_ts")).alias("baseline_mean"), side(F.col("timestamp") >= F.col("start_ts")).alias("faulty_mean"))
    t = t.where("baseline_mean is not null and faulty_mean is not null").withColumn("absolute_lift", F.col("faulty_mean") - F.col("baseline_mean"))
    return t.withColumns({"relative_lift": F.col("absolute_lift") / (F.abs("baseline_mean") + 1e-9), "evidence_type": root_type(evidence_type(F.col("metric")))})


def separate_lift(metrics: DataFrame, windows: DataFrame, key: str, cell: float = 3600.0) -> DataFrame:
    """blind_lift for many windows: (key, service, metric, baseline_mean, faulty_mean, absolute_lift) where both sides have rows; null where one has no value.

    Rows inside a window are found by time cells, so their number decides. Means ahead of a start are running sums: within
    cells of ``cell`` seconds, joined with the running sums of whole cells, so no row meets a window that it is only ahead of.
    """
    of = lambda c: F.floor(F.col(c) / cell)
    rows = metrics.select("service", "metric", "timestamp", "value", of("timestamp").alias("_cell")).where("timestamp is not null")
    w = windows.select(key, "start_ts", "end_ts")
    spread = w.withColumn("_cell", F.explode(F.sequence(of("start_ts"), of("end_ts"))))
    inside = rows.join(spread, "_cell").where((F.col("timestamp") >= F.col("start_ts")) & (F.col("timestamp") <= F.col("end_ts")))
    faulty = written(inside.groupBy(key, "start_ts", "service", "metric").agg(F.avg("value").alias("faulty_mean")))

    sums = [F.sum("value").alias("_sum"), F.count("value").alias("_values"), F.count("*").alias("_rows")]
    names = ("_sum", "_values", "_rows")
    up_to = lambda over: [F.sum(c).over(over).alias(f"{c}_before") for c in names]
    one = rows.groupBy("service", "metric", "_cell", "timestamp").agg(*sums)
    starts = faulty.select("service", "metric", of("start_ts").alias("_cell"), F.col("start_ts").alias("timestamp")).distinct()
    asked = starts.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ("double", "long", "long"))])
    # a start comes ahead of the rows of its own time
    both = one.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True)))
    ordered = Window.partitionBy("service", "metric", "_cell").orderBy("timestamp", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, -1)
    within = both.select("service", "metric", "_cell", "timestamp", "_asks", *up_to(ordered)).where("_asks")
    cells = one.groupBy("service", "metric", "_cell").agg(*[F.sum(c).alias(c) for c in names])
    asks = starts.select("service", "metric", "_cell").distinct().select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ("double", "long", "long"))])
    cells = cells.unionByName(asks).groupBy("service", "metric", "_cell").agg(*[F.sum(c).alias(c) for c in names])
    along = Window.partitionBy("service", "metric").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.select("service", "metric", "_cell", *[F.sum(c).over(along).alias(f"{c}_ahead") for c in names])
    total = lambda c: F.coalesce(f"{c}_before", F.lit(0)) + F.coalesce(f"{c}_ahead", F.lit(0))
    same = lambda at: F.col("a.service").eqNullSafe(F.col("b.service")) & F.col("a.metric").eqNullSafe(F.col("b.metric")) & at
    means = within.alias("a").join(ahead.alias("b"), same(F.col("a._cell") == F.col("b._cell"))).where(total("_rows") > 0).select(
        "a.service", "a.metric", "timestamp", F.when(total("_values") > 0, total("_sum") / total("_values")).alias("baseline_mean")
    )
    both = faulty.alias("a").join(means.alias("b"), same(F.col("start_ts") == F.col("b.timestamp")))
    return both.select(key, "a.service", "a.metric", "baseline_mean", "faulty_mean", (F.col("faulty_mean") - F.col("baseline_mean")).alias("absolute_lift"))


def normalised_evidence(lift: DataFrame, key: str) -> DataFrame:
    """Positive lift over the largest of its window and type; rows without positive lift go."""
    up = lift.where("absolute_lift > 0")
    top = F.max("absolute_lift").over(Window.partitionBy(key, "evidence_type"))
    return up.withColumn("evidence_score", F.col("absolute_lift") / top)


def top_per_type(scored: DataFrame, key: str, least: float, k: int) -> DataFrame:
    w = Window.partitionBy(key, "evidence_type").orderBy(F.desc("evidence_score"), F.desc("absolute_lift"), "service", "metric")
    return scored.where(F.col("evidence_score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evidence_strength(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean absolute evidence per (incident, service, metric), and per (incident, service, type) with its supporting metrics."""
    e = evidence.withColumn("evidence_type", evidence_type(F.col("metric")))
    exact = e.groupBy("incident_id", "service", "metric").agg(F.avg(F.abs("value")).alias("exact"))
    kind = e.groupBy("incident_id", "service", "evidence_type").agg(F.avg(F.abs("value")).alias("by_type"), F.sort_array(F.collect_set("metric")).alias("support"))
    return exact, kind


def semantic_scores(sparse: DataFrame, evidence: DataFrame, weight: float = 3.0, anchor: float = 0.5, clip: float = 500.0, bonus: tuple = (2.0, 1.0, 0.5)) -> DataFrame:
    """Sparse candidates fused with evidence: exact, same-type and service bonuses, an anchor, metric specificity, rank."""
    exact, kind = evidence_strength(evidence)
    service = kind.groupBy("incident_id", "service").agg(F.max("by_type").alias("by_service"))
    c = sparse.withColumn("evidence_type", evidence_type(F.col("metric")))
    c = c.join(exact, ["incident_id", "service", "metric"], "left").join(kind.drop("support"), ["incident_id", "service", "evidence_type"], "left").join(service, ["incident_id", "service"], "left")
    raw = sum((b * F.coalesce(x, F.lit(0.0)) for b, x in zip(bonus, ("exact", "by_type", "by_service"))), F.lit(0.0))
    w = Window.partitionBy("incident_id")
    c = c.withColumn("raw", raw).withColumns({"top_raw": F.max("raw").over(w), "top_sparse": F.max("intervention_score").over(w)})
    score = F.when(F.col("top_raw") > 0, F.col("raw") / (F.col("top_raw") + 1e-12)).otherwise(0.0)
    c = c.withColumn("evidence_score", score)
    lift = anchor * weight * F.col("evidence_score") * F.col("top_sparse")
    base = F.when((F.col("intervention_score") == 0) & (F.col("evidence_score") > 0), F.col("evidence_score")).otherwise(F.col("intervention_score") * (1 + weight * F.col("evidence_score")))
    c = c.withColumn("semantic_score", F.greatest(F.lit(0.0), F.least(F.lit(clip), (base + lift) * specificity(F.col("metric")))))
    order = Window.partitionBy("incident_id").orderBy(F.desc("semantic_score"), "service", "metric")
    return c.withColumn("semantic_rank", F.row_number().over(order)).drop("exact", "by_type", "by_service", "raw", "top_raw", "top_sparse")


def type_scores(semantic: DataFrame, most: int = 10) -> DataFrame:
    """Sum of the best ``most`` scores of each root type."""
    w = Window.partitionBy("incident_id", "root_type").orderBy(F.desc("semantic_score"), "service", "metric")
    t = semantic.withColumn("root_type", root_type(F.col("evidence_type"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    t = t.groupBy("incident_id", "root_type").agg(F.sum("semantic_score").alias("type_score"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("type_score"), "root_type")))


def calibrate(residuals: DataFrame, clip: float = 10.0, least: int = 3, eps: float = 1e-6) -> DataFrame:
    """Residuals over the median and MAD of their family (all families where one has too few rows)."""
    from faultline.operators.baselines import MAD, median_mad

    fam = median_mad(residuals, ["incident_id", "family"], "residual").select("incident_id", "family", F.col("n").alias("fn"), F.col("median").alias("fm"), F.col("mad").alias("fd"))
    every = median_mad(residuals, ["incident_id"], "residual").select("incident_id", F.col("median").alias("gm"), F.col("mad").alias("gd"))
    j = residuals.join(fam, ["incident_id", "family"]).join(every, "incident_id")
    own = F.col("fn") >= least
    z = (F.col("residual") - F.when(own, F.col("fm")).otherwise(F.col("gm"))) / (MAD * F.when(own, F.col("fd")).otherwise(F.col("gd")) + eps)
    return j.withColumn("calibrated", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("fn", "fm", "fd", "gm", "gd")


def group_strength(evidence: DataFrame, group: list[str]) -> DataFrame:
    """Largest strength of each channel, noisy-or over the channels."""
    best = evidence.groupBy(*group, "channel").agg(F.max("strength").alias("s"))
    return best.groupBy(*group).agg(noisy_or(F.collect_list("s")).alias("strength"), F.count("*").alias("channels"))


def usable(evidence: DataFrame, cutoff: Column, least_quality: float) -> DataFrame:
    """The first reason against each piece of evidence, or accepted."""
    why = F.when(F.col("timestamp") > cutoff, "after_cutoff").when(F.col("quality") < least_quality, "low_quality").when(F.arrays_overlap("sources", "residual_sources"), "circular")
    return evidence.withColumn("decision", why.otherwise("accepted"))


def deduplicated(records: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """One row per key where all payloads agree; keys with differing payloads are conflicts."""
    h = F.sha2(F.to_json(F.struct(*payload)), 256)
    t = records.withColumn("_h", h).groupBy(*keys).agg(F.count_distinct("_h").alias("versions"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in payload])
    return t.withColumn("conflict", F.col("versions") > 1).drop("versions")


def mapped_events(events: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events with the service whose identity interval holds their time: mapped, or unmapped, or reused where several do."""
    j = events.join(intervals.select("cgroup", F.col("service").alias("owner"), "valid_from", "valid_to"), "cgroup", "left")
    inside = (F.col("timestamp") >= F.col("valid_from")) & (F.col("timestamp") < F.col("valid_to"))
    t = j.groupBy(*events.columns).agg(F.count_distinct(F.when(inside, F.struct("owner", "valid_from"))).alias("n"), F.min(F.when(inside, F.col("owner"))).alias("owner"))
    return t.withColumn("status", F.when(F.col("n") == 0, "unmapped").when(F.col("n") == 1, "mapped").otherwise("reused")).drop("n")


def sequence_loss(events: DataFrame, stream: str, seq: str) -> DataFrame:
    """Events lost per stream by gaps in the sequence, and the share lost."""
    before = F.max(seq).over(Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    t = events.withColumn("gap", F.greatest(F.col(seq) - before - 1, F.lit(0))).groupBy(stream).agg(F.count("*").alias("seen"), F.sum("gap").alias("lost"))
    return t.withColumn("loss_rate", F.col("lost") / (F.col("seen") + F.col("lost")))


def nearest_checkpoints(windows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """For each window of a key the last mark at or before its start and the first at or after its end: two as-of joins."""
    j = windows.join(marks.select(key, F.col("timestamp").alias("mt"), F.col("value").alias("mv")), key, "left")
    early, late = F.col("mt") <= F.col("start_ts"), F.col("mt") >= F.col("end_ts")
    t = j.groupBy(*windows.columns).agg(
        F.max(F.when(early, F.struct("mt", "mv"))).alias("a"), F.min(F.when(late, F.struct("mt", "mv"))).alias("b")
    )
    return t.select(*windows.columns, (F.col("b.mv") - F.col("a.mv")).alias("difference"), (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int").alias("coverage"))
