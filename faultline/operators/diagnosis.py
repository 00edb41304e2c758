"""Root candidates, choices, paths, results and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators.topology import hops


def energy(rows: DataFrame, keys: list[str], weight: str, value: str) -> DataFrame:
    """Weighted energy of each candidate."""
    return rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col(weight) * F.col(value) * F.col(value))).alias("energy"))


def coherence(signatures: DataFrame) -> DataFrame:
    """Largest absolute cosine of each service's signature (incident_id, service, metric, x) with another's of the incident."""
    norm = signatures.groupBy("incident_id", "service").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a = signatures.join(norm, ["incident_id", "service"])
    b = a.select("incident_id", "metric", F.col("service").alias("other"), F.col("x").alias("ox"), F.col("n").alias("on"))
    j = a.join(b, ["incident_id", "metric"]).where("service <> other")
    c = j.groupBy("incident_id", "service", "other").agg((F.sum(F.col("x") * F.col("ox")) / (F.max("n") * F.max("on") + 1e-12)).alias("c"))
    return c.groupBy("incident_id", "service").agg(F.max(F.abs("c")).alias("coherence"))


def entropy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entropy of the absolute shares of a key's rows over its largest possible; one row: 0."""
    p = F.abs(value) / F.sum(F.abs(value)).over(Window.partitionBy(*keys))
    t = rows.withColumn("p", p).groupBy(*keys).agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)).alias("s"), F.count("*").alias("n"))
    return t.select(*keys, F.when(F.col("n") > 1, -F.col("s") / F.log("n")).otherwise(0.0).alias("entropy"))


def margins(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("incident_id").orderBy(F.desc("score"), "service")
    return scores.select("incident_id", "service", (F.col("score") - F.lead("score").over(w)).alias("margin"))


def confidence(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("incident_id")
    z = (F.col("score") - F.avg("score").over(w)) / (F.stddev_pop("score").over(w) + 1e-9)
    return scores.select("incident_id", "service", (1 / (1 + F.exp(-z))).alias("confidence"))


def primary(scores: DataFrame, close: float = 0.1, strong: float = 1.0) -> DataFrame:
    """The best service of each incident and whether the choice is strong, weak, ambiguous or none."""
    w = Window.partitionBy("incident_id").orderBy(F.desc("score"), "service")
    t = scores.withColumns({"margin": F.col("score") - F.lead("score").over(w), "r": F.row_number().over(w)}).where("r = 1")
    choice = F.when(F.col("score") <= 0, "none").when(F.col("margin") < close * F.col("score"), "ambiguous").when(F.col("score") >= strong, "strong").otherwise("weak")
    return t.select("incident_id", "service", choice.alias("choice"))


def propagated(scores: DataFrame, edges: DataFrame, share: float) -> DataFrame:
    """Services of which a called service explains at least ``share`` of the score."""
    t = scores.select("incident_id", F.col("service").alias("dst"), F.col("score").alias("cause"))
    j = scores.join(edges, F.col("service") == F.col("src")).join(t, ["incident_id", "dst"])
    return j.where((F.col("cause") * F.col("weight") >= share * F.col("score")) & (F.col("score") > 0)).select("incident_id", "service").distinct()


def path_mode(incidents: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """How the symptom is reached from the root: along the edges, against them, or not at all; and in how many hops."""
    seeds = incidents.select(F.col("root_service").alias("seed")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    d = hops(seeds, edges.select("src", "dst"), most).select(F.col("seed").alias("root_service"), F.col("node").alias("symptom_service"), F.col("hop").alias("dh"))
    r = hops(seeds, back, most).select(F.col("seed").alias("root_service"), F.col("node").alias("symptom_service"), F.col("hop").alias("rh"))
    j = incidents.join(d, ["root_service", "symptom_service"], "left").join(r, ["root_service", "symptom_service"], "left")
    mode = F.when(F.col("dh").isNotNull(), "directed").when(F.col("rh").isNotNull(), "reverse").otherwise("missing")
    return j.select("incident_id", mode.alias("mode"), F.coalesce("dh", "rh").alias("hops"))


def ranked_list(rows: DataFrame, key: str, order: list[Column], item: Column) -> DataFrame:
    """(key, ranked): items of each key in order."""
    t = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return t.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", item.alias("i")))), lambda x: x["i"]).alias("ranked"))


def root_choice(services: DataFrame, metrics: DataFrame) -> DataFrame:
    """The best service of each incident, then the best metric within it."""
    s = services.withColumn("r", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "service"))).where("r = 1").select("incident_id", "service")
    m = metrics.join(s, ["incident_id", "service"]).withColumn("r", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "metric")))
    return m.where("r = 1").select("incident_id", F.col("service").alias("root_service"), F.col("metric").alias("root_metric"))


def positions(labels: DataFrame, ranked: DataFrame, target: Column) -> DataFrame:
    """Labels with pos, the place of the target in the ranked list (0 or null: absent). Labels are for evaluation only."""
    return labels.join(ranked, "incident_id", "left").withColumn("pos", F.array_position("ranked", target))


def hits(placed: DataFrame) -> DataFrame:
    at = lambda k: F.avg(F.when(F.col("pos").between(1, k), 1.0).otherwise(0.0))
    return placed.agg(at(1).alias("hit1"), at(3).alias("hit3"), F.avg(F.when(F.col("pos") > 0, 1.0 / F.col("pos")).otherwise(0.0)).alias("mrr"))


def continuity(rows: DataFrame, stream: str, seq: str) -> DataFrame:
    """Range, count, gaps and duplicates of each stream's sequence."""
    gap = F.col(seq) - F.lag(seq).over(Window.partitionBy(stream).orderBy(seq))
    t = rows.select(stream, seq, gap.alias("gap"))
    return t.groupBy(stream).agg(
        F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n"), F.sum(F.when(F.col("gap") > 1, 1).otherwise(0)).alias("gaps"), (F.count("*") - F.count_distinct(seq)).alias("duplicates")
    )


def identifiability(cf: Column, path: Column, margin: Column, coherence: Column, entropy: Column, weights: tuple = (0.5, 0.2, 0.3), doubts: tuple = (0.7, 0.3)) -> Column:
    """Weighted mean of what speaks for a candidate (counterfactual, path, margin), less the weighted mean of what blurs it (coherence, entropy)."""
    mean = lambda w, cols: sum((k * c for k, c in zip(w, cols)), F.lit(0.0)) / sum(w)
    return F.least(F.greatest(mean(weights, (cf, path, margin)) * (1 - mean(doubts, (coherence, entropy))), F.lit(0.0)), F.lit(1.0))


def weighted_confidence(cf: Column, margin: Column, quality: Column, ident: Column, weights: tuple = (0.4, 0.2, 0.2, 0.2)) -> Column:
    return F.least(F.greatest(sum((k * c for k, c in zip(weights, (cf, margin, quality, ident))), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def told_apart(gains: DataFrame, signature: DataFrame, quality: DataFrame) -> DataFrame:
    """How far each candidate of an alert can be told from the others, and the confidence in it.

    gains (service, win, root_service, hop, gain): what each candidate explains; signature (root_service, win, metric, x) and
    quality (root_service, win, quality) of the candidates. Pairs are made among the candidates of one alert, which lie within a few hops.
    """
    alert = ["service", "win"]
    share = F.col("gain") / (F.sum("gain").over(Window.partitionBy(*alert)) + 1e-12)
    r = gains.withColumn("relative", share)
    rivals = F.array_compact(F.transform(F.collect_list("relative").over(Window.partitionBy(*alert)), lambda o: F.when((o > 0) & (o != F.col("relative")), o)))
    sorted_ = F.array_sort("rivals")
    n = F.size("rivals")
    median = (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2
    with_cf = r.withColumn("rivals", rivals).withColumn("cf", F.when(n == 0, 1.0).otherwise(F.least(F.greatest(F.col("relative") / (F.col("relative") + median + 1e-12), F.lit(0.0)), F.lit(1.0)))).drop("rivals")
    down = Window.partitionBy(*alert).orderBy(F.desc("relative"), "root_service")
    after = F.coalesce(F.lead("relative").over(down), F.lit(0.0))
    alone = F.count("*").over(Window.partitionBy(*alert)) == 1
    t = with_cf.withColumns({"margin": F.when(alone, 1.0).otherwise(F.greatest(F.col("relative") - after, F.lit(0.0)) / F.greatest("relative", F.lit(1e-12))), "path": 1 / (1.0 + F.col("hop"))})
    vector = signature.groupBy("root_service", "win").agg(F.map_from_entries(F.collect_list(F.struct("metric", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("x") > 0, F.col("x"))).alias("mass"))
    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    entropy = F.when(F.size("mass") <= 1, 0.0).otherwise(-F.aggregate(F.transform("mass", lambda x: x / total * F.log(x / total)), F.lit(0.0), lambda a, x: a + x) / F.log(F.size("mass")))
    own = t.join(vector.withColumn("entropy", entropy).drop("mass"), ["root_service", "win"])
    other = own.select(*alert, F.col("root_service").alias("other"), F.col("m").alias("om"), F.col("norm").alias("onorm"))
    dot = F.aggregate(F.map_entries("m"), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.col("om")[e["key"]], F.lit(0.0)))
    near = own.join(other, alert).where("root_service <> other").groupBy(*alert, "root_service").agg(F.max(F.when(F.col("norm") == 0, 0.0).otherwise(F.abs(dot) / (F.col("norm") * F.col("onorm") + 1e-12))).alias("coherence"))
    whole = own.join(near, [*alert, "root_service"], "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0))).join(quality, ["root_service", "win"])
    c = F.col
    scored = whole.withColumn("identifiability", identifiability(c("cf"), c("path"), c("margin"), c("coherence"), c("entropy")))
    return scored.select(*alert, "root_service", "hop", "gain", "relative", "cf", "path", "margin", "coherence", "entropy", "quality", "identifiability", weighted_confidence(c("cf"), c("margin"), c("quality"), c("identifiability")).alias("confidence"))
