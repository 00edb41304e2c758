"""Alert detection, streaks, windows and state machines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.scalars import RESOURCE_METRICS, STRONG_SYMPTOMS, alert_score
from .tables import written


def streaks(rows: DataFrame, keys: list[str], order: list[str], high: Column) -> DataFrame:
    """rows plus streak: how many consecutive rows up to this one are high (0 where it is not)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.sum((~high).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumns({"_high": high, "_island": island})
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.col("_high").cast("long")).over(inside)).drop("_high", "_island")


def composite(scores: DataFrame, keys: list[str], order: str, selectors: DataFrame, need: int) -> DataFrame:
    """Streaks of windows in which all (or any) selectors of a rule are met on the same key; selectors is a fixed small table."""
    met = scores.join(F.broadcast(selectors), "metric").where(F.col("score") > F.col("least"))
    counted = met.groupBy(*keys, order, "rule", "mode", "parts").agg(F.count_distinct("metric").alias("hits"))
    fired = counted.withColumn("fired", F.when(F.col("mode") == "all", F.col("hits") >= F.col("parts")).otherwise(F.col("hits") > 0))
    return streaks(fired, [*keys, "rule"], [order], F.col("fired")).withColumn("alert", F.col("streak") >= need)


def business_impact(edges: DataFrame, services: DataFrame, threshold: float) -> DataFrame:
    """edges plus impact: does an endpoint's score exceed the threshold in the same window."""
    s = services.select("window", "service", "score")
    a, b = s.select("window", F.col("service").alias("src"), F.col("score").alias("src_score")), s.select("window", F.col("service").alias("dst"), F.col("score").alias("dst_score"))
    both = edges.join(a, ["window", "src"], "left").join(b, ["window", "dst"], "left")
    worst = F.greatest(F.coalesce("src_score", F.lit(0.0)), F.coalesce("dst_score", F.lit(0.0)))
    return both.withColumn("impact", F.when(worst > threshold, "business").otherwise("isolated_edge")).drop("src_score", "dst_score")


def state_machine(windows: DataFrame, key: str, order: str, soft: float, hard: float, soft_n: int, hard_n: int, recover_n: int, cooldown: int, carried: DataFrame | None = None) -> DataFrame:
    """Alert state of each window: healthy, soft, hard, recovery; an ordered fold per key over one row for each window.

    Columns: key, order, score. A hard alert holds until ``recover_n`` calm windows (then recovery, then healthy after
    ``cooldown`` more); a soft one until a calm window. In recovery ``hard_n`` hot windows alert again.
    carried: (key, state, s, h, calm) that earlier windows have left.
    """
    start = F.struct(F.lit("healthy").alias("state"), F.lit(0).alias("s"), F.lit(0).alias("h"), F.lit(0).alias("calm"))
    fields = "struct<state:string,s:int,h:int,calm:int>"
    if carried is not None:
        start = F.coalesce("_carried", start.cast(fields))
    start = F.struct(start.alias("now"), F.array().cast(f"array<struct<at:double,score:double,state:string,s:int,h:int,calm:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        s = F.when(x["score"] >= soft, now["s"] + 1).otherwise(0)
        h = F.when(x["score"] >= hard, now["h"] + 1).otherwise(0)
        calm = F.when(x["score"] < soft, now["calm"] + 1).otherwise(0)
        is_hard, is_soft = h >= hard_n, s >= soft_n
        state = (
            F.when(is_hard, "hard")
            .when(now["state"] == "hard", F.when(calm >= recover_n, "recovery").otherwise("hard"))
            .when(now["state"] == "recovery", F.when(calm >= recover_n + cooldown, "healthy").otherwise("recovery"))
            .when(is_soft, "soft")
            .when(now["state"] == "soft", F.when(calm >= 1, "healthy").otherwise("soft"))
            .otherwise("healthy")
        )
        fresh = F.struct(state.alias("state"), s.cast("int").alias("s"), h.cast("int").alias("h"), calm.cast("int").alias("calm"))
        row = F.struct(x["at"].alias("at"), x["score"].alias("score"), state.alias("state"), s.cast("int").alias("s"), h.cast("int").alias("h"), calm.cast("int").alias("calm"))
        return F.struct(fresh.cast(fields).alias("now"), F.concat(acc["out"], F.array(row)).alias("out"))

    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).cast("double").alias("at"), F.col("score").cast("double").alias("score"))))
    lists = windows.groupBy(key).agg(ordered.alias("w"))
    if carried is not None:
        lists = lists.join(carried.select(key, F.struct("state", "s", "h", "calm").cast(fields).alias("_carried")), key, "left")
    folded = lists.select(key, F.aggregate("w", start, step)["out"].alias("out"))
    return folded.select(key, F.inline("out"))


def state_changes(states: DataFrame, key: str, order: str = "at") -> DataFrame:
    """Alert events: one for each change of state, with the state before and a stable id."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy(key).orderBy(order)), F.lit("healthy"))
    changed = states.withColumn("previous", before).where("state <> previous")
    return changed.withColumn("alert_id", F.sha2(F.concat_ws("|", F.col(key), F.col(order).cast("long").cast("string"), "state"), 256))


def update_gate(states: DataFrame) -> DataFrame:
    """What may learn in each window: baselines only when healthy, models also in recovery."""
    return states.withColumns({"baseline_may_learn": F.col("state") == "healthy", "model_may_learn": F.col("state").isin("healthy", "recovery"), "frozen": F.col("state").isin("soft", "hard")})


def typical_step(rows: DataFrame, keys: list[str], order: str, factor: float = 1.5, least: float = 5.0) -> DataFrame:
    """One row: the median positive gap between rows of a series times ``factor``, ``least`` at least."""
    gap = rows.select((F.col(order) - F.lag(order).over(Window.partitionBy(*keys).orderBy(order))).alias("gap")).where("gap > 0")
    return gap.agg(F.greatest(F.lit(least), F.coalesce(F.percentile("gap", 0.5) * factor, F.lit(10.0))).alias("step"))


def detect(scored: DataFrame, step: float | Column, soft: float = 3.0, hard: float = 6.0, consecutive: int = 2) -> DataFrame:
    """Alert events from scored rows (event_id, timestamp, service, metric, value, z_score).

    A strong symptom at the soft threshold alerts; it is hard at the hard threshold, after consecutive highs of latency, or with
    a resource anomaly within ``step`` seconds. Resources are looked up per time cell of that width and its neighbours.
    """
    latency = F.col("metric").isin(*STRONG_SYMPTOMS[:2])
    runs = streaks(scored, ["service", "metric"], ["timestamp", "event_id"], latency & (F.col("z_score") >= soft))
    request = runs.where(F.col("metric").isin(*STRONG_SYMPTOMS) & (F.col("z_score") >= soft))
    cell = F.floor(F.col("timestamp") / step)
    resource = scored.where(F.col("metric").isin(*RESOURCE_METRICS) & (F.col("z_score") >= soft))
    resource = resource.select(F.col("timestamp").alias("rt"), F.concat_ws(".", "service", "metric").alias("resource"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = request.select("event_id", "timestamp", cell.alias("cell")).join(resource, "cell").where(F.abs(F.col("rt") - F.col("timestamp")) <= step)
    around = near.groupBy("event_id").agg(F.sort_array(F.collect_set("resource")).alias("resources"))
    joined = request.join(around, "event_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("z_score") >= hard, "z"), F.when(F.col("streak") >= consecutive, "consecutive"), F.when(F.col("resources").isNotNull(), "resource"),
    ))
    out = joined.withColumns({"reasons": reasons, "alert_score": alert_score(F.col("metric"), F.col("z_score"))})
    return out.withColumn("severity", F.when(F.size("reasons") > 0, "hard").otherwise("soft"))


def alert_windows(events: DataFrame, before: float = 30.0, after: float = 60.0, by: list[str] | None = None, cell: float = 3600.0) -> DataFrame:
    """Events whose padded intervals touch form a window; each with its range, severity, largest z and trigger metrics.

    Windows are told apart per ``by`` (a cluster or tenant), without it over all events. An event opens a window if the time before
    its own ends too early, so distinct times decide. They are numbered within cells of ``cell`` seconds; the ends of cells are
    stitched over one row a cell, a table that grows with the time spanned, not with the events. Events without a time have no window.
    """
    keys = by or []
    events = written(events)
    times = events.where("timestamp is not null").select(*keys, "timestamp", F.floor(F.col("timestamp") / cell).alias("_cell")).distinct()
    apart = lambda at, last: at - before > last + after
    w = Window.partitionBy(*keys, "_cell").orderBy("timestamp")
    opens = F.coalesce(apart(F.col("timestamp"), F.lag("timestamp").over(w)), F.lit(False)).cast("long")
    inside = times.withColumn("_opens", opens).withColumn("_within", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.drop("_opens")
    cells = inside.groupBy(*keys, "_cell").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"), F.max("_within").alias("_more"))
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")
    cells = cells.withColumn("_new", F.coalesce(apart(F.col("_first"), F.lag("_last").over(along)), F.lit(True)).cast("long"))
    start = F.sum(F.col("_new") + F.col("_more")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_more")
    cells = cells.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_cell").alias("_c"), start.alias("_start"))
    same = lambda a, b: reduce(lambda x, k: x & F.col(a(k)).eqNullSafe(F.col(b(k))), keys, F.lit(True))
    numbered = inside.join(cells, (F.col("_cell") == F.col("_c")) & same(lambda k: k, lambda k: f"_c_{k}"))
    numbered = numbered.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col("timestamp").alias("_at"), (F.col("_start") + F.col("_within")).alias("window_no"))
    return events.join(numbered, (F.col("timestamp") == F.col("_at")) & same(lambda k: k, lambda k: f"_n_{k}")).select(*events.columns, "window_no")


def window_summary(numbered: DataFrame, before: float = 30.0, after: float = 60.0, by: list[str] | None = None) -> DataFrame:
    return numbered.groupBy(*(by or []), "window_no").agg(
        (F.min("timestamp") - before).alias("start_ts"), (F.max("timestamp") + after).alias("end_ts"), F.max("z_score").alias("max_z"), F.count("*").alias("event_count"),
        F.when(F.bool_or(F.col("severity") == "hard"), "hard").otherwise("soft").alias("severity"), F.sort_array(F.collect_set(F.concat_ws(".", "service", "metric"))).alias("trigger_metrics"),
    )


def symptom_vote(numbered: DataFrame) -> DataFrame:
    """Per window the service with most events, then largest z, then largest score, then name."""
    votes = numbered.groupBy("window_no", "service").agg(F.count("*").alias("votes"), F.max("z_score").alias("z"), F.max("alert_score").alias("score"))
    w = Window.partitionBy("window_no").orderBy(F.desc("votes"), F.desc("z"), F.desc("score"), "service")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("window_no", F.col("service").alias("symptom_service"), "votes")


def overlap_check(windows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident how many alert windows overlap it, ends included (for evaluation only)."""
    hit = (F.col("w.start_ts") <= F.col("i.end_ts")) & (F.col("i.start_ts") <= F.col("w.end_ts"))
    pairs = incidents.alias("i").join(windows.alias("w"), hit, "left")
    return pairs.groupBy("i.incident_id").agg(F.count("w.window_no").alias("windows")).withColumn("covered", F.col("windows") > 0)


def calibration(windows: DataFrame, key: str, order: str, changed: Column, healthy: Column, need: int) -> DataFrame:
    """Segment since the last topology change and the progress within it: starting, calibrating, ready."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seg = windows.withColumn("segment", F.sum(changed.cast("int")).over(w))
    run = streaks(seg, [key, "segment"], [order], healthy)
    stage = F.when(F.max(F.col("streak")).over(Window.partitionBy(key, "segment").orderBy(order)) >= need, "ready").when(F.col("streak") > 0, "calibrating").otherwise("starting")
    return run.withColumn("stage", stage)
