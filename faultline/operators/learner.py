"""Online propagation models of services whose topology changes.

Spark makes one row of lagged parent values for each (target, window); the update is sequential per target and runs over
rows in order, one target after the other, with the state of one target in memory. When the topology changes, a target's
coefficients and covariance go over to the features that stay, new features begin afresh, and a target that has left the
topology is archived.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = "target string, win long, version int, keys array<string>, x array<double>, reason string, y double, learns boolean, gate_reason string, quality double"
RESULT = "target string, win long, version int, predicted double, actual double, residual double, ready boolean, updated boolean, reason string, updates int, contributions array<struct<feature:string,coefficient:double,x:double,part:double>>"


def topology_versions(windows: DataFrame, services: DataFrame, edges: DataFrame) -> DataFrame:
    """(win, snapshot_id, version): version counts the changes of structure among the snapshots that windows (win, snapshot_id) use.

    services (snapshot_id, service) and edges (snapshot_id, parent, target) make up the structure. Snapshots in a row with the same
    structure are one version. Snapshots are few against windows; they are numbered in one task.
    """
    item = lambda *c: F.concat_ws("\x1f", *c)
    parts = services.select("snapshot_id", item(F.lit("s"), "service").alias("p")).unionByName(edges.select("snapshot_id", item(F.lit("e"), "parent", "target").alias("p")))
    prints = parts.groupBy("snapshot_id").agg(F.sha2(F.concat_ws("\x1e", F.array_sort(F.collect_set("p"))), 256).alias("print"))
    used = windows.groupBy("snapshot_id").agg(F.min("win").alias("since")).join(prints, "snapshot_id")
    w = Window.partitionBy(F.lit(0)).orderBy("since")
    changed = used.withColumn("c", F.coalesce((F.col("print") != F.lag("print").over(w)).cast("int"), F.lit(0)))
    numbered = changed.select("snapshot_id", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("version"))
    return windows.join(F.broadcast(numbered), "snapshot_id").select("win", "snapshot_id", "version")


def history_breaks(windows: DataFrame, max_gap: int) -> DataFrame:
    """Windows (win) before which more than ``max_gap`` windows are missing; the first window is none."""
    reached = windows.select(F.explode(F.sequence(F.col("win") + 1, F.col("win") + max_gap)).alias("win")).distinct()
    return windows.select("win").distinct().join(reached, "win", "left_anti").join(F.broadcast(windows.agg(F.min("win").alias("first"))), F.col("win") > F.col("first")).select("win")


def feature_rows(states: DataFrame, versions: DataFrame, services: DataFrame, edges: DataFrame, gates: DataFrame, lags: list[int], least_quality: float, max_gap: int) -> DataFrame:
    """One row for each service of the topology and window, in the form of FEATURES.

    states: (service, win, value, ready, quality), one row each; gates: (win, learns). Features are the service itself and its
    parents, each at each lag, by name. x is null with the first reason found if a lagged window is unknown (or lies before a
    break of the history), a parent has no state in it, its baseline was not ready or its quality too low; y is null if the
    target itself has no state.
    """
    breaks = history_breaks(versions, max_gap)
    longest = max(lags)
    #: The lags of a window that reach behind a break.
    cut = breaks.select(F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("j"), "win").groupBy((F.col("win") + F.col("j")).alias("win")).agg(F.min("j").alias("j"))
    known = versions.select(F.col("win").alias("from_win"), F.lit(True).alias("known"))
    parents = services.select("snapshot_id", F.col("service").alias("target"), F.col("service").alias("parent")).unionByName(edges.select("snapshot_id", "target", "parent")).distinct()
    grid = versions.join(parents, "snapshot_id").select("win", "version", "target", "parent", F.explode(F.array(*[F.lit(k) for k in sorted(lags)])).alias("lag"))
    past = states.select(F.col("service").alias("parent"), F.col("win").alias("from_win"), "value", "ready", F.col("quality").alias("q"))
    found = grid.withColumn("from_win", F.col("win") - F.col("lag")).join(F.broadcast(known), "from_win", "left").join(F.broadcast(cut), "win", "left").join(past, ["parent", "from_win"], "left")
    why = (
        F.when(F.col("known").isNull() | (F.col("j") < F.col("lag")), "insufficient_history").when(F.col("value").isNull(), "missing_parent_state")
        .when(~F.col("ready"), "baseline_not_ready").when(F.col("q") < least_quality, "low_observation_quality")
    )
    wide = found.groupBy("target", "win", "version").agg(F.array_sort(F.collect_list(F.struct("parent", "lag", F.col("value").alias("x"), why.alias("why")))).alias("f"))
    reason = F.get(F.filter(F.transform("f", lambda f: f["why"]), lambda r: r.isNotNull()), F.lit(0))
    now = states.select(F.col("service").alias("target"), "win", F.col("value").alias("y"), F.col("ready").alias("own_ready"), "quality")
    rows = wide.join(now, ["target", "win"], "left").join(F.broadcast(gates), "win", "left")
    closed = (
        F.when(~F.coalesce("learns", F.lit(False)), "update_gate_closed").when(~F.col("own_ready"), "baseline_not_ready").when(F.col("quality") < least_quality, "low_observation_quality")
    )
    return rows.select(
        "target", "win", "version", F.transform("f", lambda f: F.concat_ws("@", f["parent"], f["lag"].cast("string"))).alias("keys"), F.when(reason.isNull(), F.transform("f", lambda f: f["x"])).alias("x"),
        F.when(F.col("y").isNull(), "missing_target").otherwise(reason).alias("reason"), "y", closed.isNull().alias("learns"), closed.alias("gate_reason"), "quality",
    )


def window_issues(features: DataFrame, versions: DataFrame, services: DataFrame, max_gap: int) -> DataFrame:
    """(win, target, issue, detail): breaks of the history, changes of the topology, services that it archives, and targets without a prediction."""
    begins = versions.groupBy("version").agg(F.min("win").alias("win"), F.min_by("snapshot_id", "win").cast("string").alias("detail"))
    star = F.lit("*").alias("target")
    gaps = history_breaks(versions, max_gap).select("win", star, F.lit("history_gap").alias("issue"), F.lit("").alias("detail"))
    changes = begins.select("win", star, F.when(F.col("version") == 0, "topology_configured").otherwise("topology_reconfigured").alias("issue"), "detail")
    member = services.join(versions.select("snapshot_id", "version").distinct(), "snapshot_id").select("version", "service").distinct()
    gone = member.withColumn("version", F.col("version") + 1).join(member, ["version", "service"], "left_anti").join(begins, "version")
    archived = gone.select("win", F.col("service").alias("target"), F.lit("service_archived").alias("issue"), "detail")
    silent = features.where("reason is not null").select("win", "target", F.col("reason").alias("issue"), F.lit("").alias("detail"))
    return gaps.unionByName(changes).unionByName(archived).unionByName(silent)


class TargetModel:
    """Recursive least squares of one target. The state is plain lists, so that a state store can hold it."""

    def __init__(self, forgetting: float = 0.98, start: float = 100.0, least_updates: int = 5, least_since: int = 2, state: tuple | None = None):
        self.rule = (forgetting, start, least_updates, least_since)
        keys, theta, p, self.updates, self.since, self.version = state or ([], [], [], 0, 0, -2)
        self.keys, self.theta = list(keys), np.array(theta, float)
        self.p = np.array(p, float).reshape(len(self.keys), len(self.keys))

    def state(self) -> tuple:
        return self.keys, self.theta.tolist(), self.p.ravel().tolist(), self.updates, self.since, self.version

    def follow(self, version: int, keys: list[str]) -> None:
        """Takes over another version of the topology; versions in between without this target have archived it."""
        if version == self.version:
            return
        if version != self.version + 1:
            self.keys, self.theta, self.p, self.updates = [], np.zeros(0), np.zeros((0, 0)), 0
        at = {k: i for i, k in enumerate(self.keys)}
        new, old = [i for i, k in enumerate(keys) if k in at], [at[k] for k in keys if k in at]
        theta, p = np.zeros(len(keys)), np.eye(len(keys)) * self.rule[1]
        theta[new] = self.theta[old]
        p[np.ix_(new, new)] = self.p[np.ix_(old, old)]
        self.keys, self.theta, self.p, self.version, self.since = list(keys), theta, p, version, 0

    def step(self, row) -> tuple:
        """The prediction for a row of FEATURES, before the update that it may bring."""
        forgetting, _, least_updates, least_since = self.rule
        self.follow(int(row.version), list(row.keys))
        head = (row.target, int(row.win), int(row.version))
        if row.reason is not None:
            return (*head, None, None if pd.isna(row.y) else float(row.y), None, False, False, row.reason, self.updates, [])
        x, y = np.asarray(row.x, float), float(row.y)
        parts = [(k, float(c), float(v), float(c * v)) for k, c, v in zip(self.keys, self.theta, x)]
        guess = float(self.theta @ x)
        if row.learns:
            px = self.p @ x
            scale = forgetting + float(x @ px)
            self.theta = self.theta + px / scale * (y - guess)
            self.p = (self.p - np.outer(px, px) / scale) / forgetting
            self.updates += 1
            self.since += 1
            if not (np.isfinite(self.theta).all() and np.isfinite(self.p).all()):
                raise ArithmeticError(f"the model of {row.target} is not finite after window {row.win}")
        ready = self.updates >= least_updates and self.since >= least_since
        return (*head, guess, y, y - guess, ready, bool(row.learns), row.gate_reason, self.updates, parts)


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(reason=frame["reason"].where(frame["reason"].notna(), None), gate_reason=frame["gate_reason"].where(frame["gate_reason"].notna(), None))


def as_result(rows: Iterable[tuple]) -> pd.DataFrame:
    names = ["target", "win", "version", "predicted", "actual", "residual", "ready", "updated", "reason", "updates", "contributions"]
    out = pd.DataFrame(rows, columns=names)
    keys = ("feature", "coefficient", "x", "part")
    return out.assign(contributions=[[dict(zip(keys, c)) for c in parts] for parts in out["contributions"]])


def learn(features: DataFrame, **rule) -> DataFrame:
    """RESULT rows of all targets: each task takes its targets one after the other in window order; a long history is a stream, not a group in memory."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, model = None, None
        for frame in frames:
            out = []
            for row in plain(frame).itertuples(index=False):
                if model is None or row.target != target:
                    target, model = row.target, TargetModel(**rule)
                out.append(model.step(row))
            yield as_result(out)

    return features.repartition("target").sortWithinPartitions("target", "win").mapInPandas(scan, RESULT)
