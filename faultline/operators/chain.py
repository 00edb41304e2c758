"""The chain from windows to diagnoses: score, alert, model, candidates and roots, each stage with the state that it leaves.

Every stage takes the rows of newly closed windows and its state from before, and gives its rows and its new state. All windows
at once with empty states are the batch form; the stream runs the same stages on the windows that each micro-batch closes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators import alerts as A
from faultline.operators import learner as L

#: States between the stages.
OPEN = "service string, metric string, win long, n long, total double"
MEMORY = "service string, metric string, win long, value double"
RECENT = "service string, win long, value double, ready boolean, quality double"
ALERTS = "service string, state string, s int, h int, calm int"
MODELS = "service string, model struct<keys:array<string>,theta:array<double>,p:array<double>,updates:int,since:int,version:int>"


@dataclass(frozen=True)
class Rule:
    """Seconds of a window and of lateness; windows of the baseline and least of them; scale's floor and score's cap; alert thresholds and counts; lags, forgetting and readiness of the models; decay a hop and roots of a report."""

    width: float = 21600.0
    lateness: float = 0.0
    memory: int = 8
    least: int = 3
    floor: float = 10.0
    cap: float = 10.0
    soft: float = 2.0
    hard: float = 3.0
    soft_n: int = 1
    hard_n: int = 1
    recover_n: int = 1
    cooldown: int = 1
    lags: tuple[int, ...] = (1,)
    max_gap: int = 2
    forgetting: float = 0.98
    start: float = 100.0
    least_updates: int = 5
    decay: float = 0.8
    roots: int = 3


def accumulated(open_: DataFrame, rows: DataFrame) -> DataFrame:
    """Open windows with rows (service, metric, win, value) added."""
    new = rows.groupBy("service", "metric", "win").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return open_.unionByName(new).groupBy("service", "metric", "win").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def scored(closed: DataFrame, memory: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(service, metric, win, value, score) against the last ``memory`` windows of the series, null before ``least`` of them; and the values that later windows need."""
    values = closed.select("service", "metric", "win", (F.col("total") / F.col("n")).alias("value"))
    all_ = values.withColumn("new", F.lit(True)).unionByName(memory.withColumn("new", F.lit(False)))
    series = Window.partitionBy("service", "metric").orderBy("win")
    before = series.rowsBetween(-rule.memory, -1)
    z = (F.col("value") - F.avg("value").over(before)) / F.greatest(F.stddev_pop("value").over(before), F.lit(rule.floor))
    score = F.when(F.count("value").over(before) >= rule.least, F.least(F.greatest(z, F.lit(0.0)), F.lit(rule.cap)))
    kept = F.row_number().over(Window.partitionBy("service", "metric").orderBy(F.desc("win"))) <= rule.memory
    both = all_.withColumns({"score": score, "kept": kept})
    return both.where("new").select("service", "metric", "win", "value", "score"), both.where("kept").select("service", "metric", "win", "value")


def alerted(scores: DataFrame, alerts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(service, win, score, ready, previous, state) by the largest score of a service's metrics; and the state machines."""
    windows = scores.groupBy("service", "win").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.count("score").alias("n"))
    out = A.state_machine(windows, "service", "win", rule.soft, rule.hard, rule.soft_n, rule.hard_n, rule.recover_n, rule.cooldown, carried=alerts)
    states = out.withColumn("win", F.col("at").cast("long"))
    before = F.lag("state").over(Window.partitionBy("service").orderBy("win"))
    named = states.join(alerts.select("service", F.col("state").alias("_carried")), "service", "left").withColumn("previous", F.coalesce(before, "_carried", F.lit("healthy")))
    rows = named.join(windows.select("service", "win", (F.col("n") > 0).alias("ready")), ["service", "win"]).select("service", "win", "score", "ready", "previous", "state")
    last = states.groupBy("service").agg(F.max_by(F.struct("state", "s", "h", "calm"), "win").alias("now")).select("service", "now.*")
    return rows, last.unionByName(alerts.join(last, "service", "left_anti"))


def modelled(states: DataFrame, recent: DataFrame, models: DataFrame, parents: DataFrame, since: int | None, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(service, win, predicted, residual, ready, reason): each service's score from its own and its parents' scores before; models
    learn only in windows without a hard alert. And the states that later lags need, and the models.

    since: the last window that was closed before.
    """
    new = states.select("service", "win", F.col("score").alias("value"), "ready", F.lit(1.0).alias("quality"))
    all_ = recent.unionByName(new)
    windows = all_.select("win", F.lit("t").alias("snapshot_id"), F.lit(0).alias("version")).distinct()
    services = parents.select(F.explode(F.array("parent", "target")).alias("service")).unionByName(all_.select("service")).distinct().select(F.lit("t").alias("snapshot_id"), "service")
    gates = states.groupBy("win").agg((~F.bool_or(F.col("state") == "hard")).alias("learns"))
    features = L.feature_rows(all_, windows, services, parents.select(F.lit("t").alias("snapshot_id"), "parent", "target"), gates, list(rule.lags), 0.0, rule.max_gap)
    if since is not None:
        features = features.where(F.col("win") > since)
    settings = {"forgetting": rule.forgetting, "start": rule.start, "least_updates": rule.least_updates, "least_since": 0}

    def advance(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        service = rows["target"].iloc[0] if len(rows) else held["service"].iloc[0]
        state = held["model"].iloc[0] if len(held) else None
        fields = ("keys", "theta", "p", "updates", "since", "version")
        model = L.TargetModel(**settings, state=tuple(state[k] for k in fields) if state is not None else None)
        found = [model.step(r) for r in L.plain(rows.sort_values("win")).itertuples(index=False)]
        out = pd.DataFrame([(r[0], r[1], r[3], r[5], r[6], r[8]) for r in found], columns=["service", "win", "predicted", "residual", "ready", "reason"]).assign(model=None)
        last = pd.DataFrame([(service, None, None, None, None, None, dict(zip(fields, model.state())))], columns=out.columns)
        return pd.concat([f.astype(object) for f in (out, last) if len(f)], ignore_index=True)

    done = features.groupBy("target").cogroup(models.groupBy("service")).applyInPandas(advance, f"service string, win long, predicted double, residual double, ready boolean, reason string, {MODELS.split(', ', 1)[1]}")
    need = max(rule.lags) + rule.max_gap + 1
    top = all_.agg(F.max("win").alias("top"))
    return done, all_.join(F.broadcast(top)).where(F.col("win") > F.col("top") - need).drop("top"), done.where("model is not null").select("service", "model")


def diagnosed(states: DataFrame, scores: DataFrame, predictions: DataFrame, reach: DataFrame, rule: Rule) -> DataFrame:
    """For each service that enters a hard alert: its ``roots`` best candidates, or why there is no diagnosis.

    Candidates are the services that reach (seed, node, hop) leads to. One counts with what its model leaves unexplained,
    less by ``decay`` for each hop, and names its metric with the largest score. Without a ready model of the alerting service the alert
    gets one row with the reason instead. (service, win, status, reason, rank, root_service, root_metric, root_score, hop)
    """
    hard = states.where("state = 'hard' and previous <> 'hard'").select("service", "win")
    own = predictions.select("service", "win", F.col("ready").alias("own_ready"), F.col("reason").alias("why"))
    gate = hard.join(own, ["service", "win"], "left")
    closed = gate.where("not coalesce(own_ready, false)").select(
        "service", "win", F.lit("not_ready").alias("status"), F.coalesce(F.when(F.col("own_ready").isNull() | F.col("why").isin("insufficient_history", "missing_parent_state", "baseline_not_ready", "missing_target"), F.col("why")), F.lit("too_few_updates")).alias("reason"),
    )
    best = scores.where("score is not null").groupBy(F.col("service").alias("root_service"), "win").agg(F.max_by("metric", F.struct("score", "metric")).alias("root_metric"))
    left = predictions.where("residual is not null").select(F.col("service").alias("root_service"), "win", F.greatest("residual", F.lit(0.0)).alias("left"))
    named = gate.where("own_ready").select("service", "win").join(reach.select(F.col("seed").alias("service"), F.col("node").alias("root_service"), "hop"), "service")
    ranked = named.join(left, ["root_service", "win"]).join(best, ["root_service", "win"]).withColumn("root_score", F.col("left") * F.pow(F.lit(rule.decay), F.col("hop")))
    w = Window.partitionBy("service", "win").orderBy(F.desc("root_score"), "hop", "root_service")
    top = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rule.roots).withColumns({"status": F.lit("diagnosed"), "reason": F.lit(None).cast("string")})
    names = ["service", "win", "status", "reason", "rank", "root_service", "root_metric", "root_score", "hop"]
    return closed.unionByName(top, allowMissingColumns=True).select(*names)


def whole(rows: DataFrame, parents: DataFrame, reach: DataFrame, rule: Rule) -> dict[str, DataFrame]:
    """The chain over a whole table (service, metric, timestamp, value): scores, timeline, predictions, reports."""
    from faultline.operators.tables import written

    spark = rows.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    windows = accumulated(none(OPEN), rows.select("service", "metric", F.floor(F.col("timestamp") / rule.width).alias("win"), "value"))
    scores = written(scored(windows, none(MEMORY), rule)[0])
    timeline = written(alerted(scores, none(ALERTS), rule)[0])
    model = written(modelled(timeline, none(RECENT), none(MODELS), parents, None, rule)[0].where("win is not null").drop("model"))
    return {"scores": scores, "timeline": timeline, "predictions": model, "reports": diagnosed(timeline, scores, model, reach, rule)}
