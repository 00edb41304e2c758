"""Structured Streaming forms of the window, counter, baseline and alert operators."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.operators import learner as L


def windowed(stream: DataFrame, ts: str, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """Count and sum per tumbling event-time window; a window is final once the watermark has passed its end."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, lateness).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def alert_sessions(events: DataFrame, ts: str, gap: str, lateness: str, keys: list[str]) -> DataFrame:
    """Alert windows as sessions: events closer than the gap belong together."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, lateness).groupBy(w, *keys).agg(F.count("*").alias("events"), F.max("z_score").alias("max_z")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "events", "max_z")


def delayed_diagnosis(alerts: DataFrame, evidence: DataFrame, delay: str, lateness: str) -> DataFrame:
    """Evidence that comes within ``delay`` after an alert of its service: a stream-stream interval join, both sides watermarked.

    Rows meet by service and time cell of that width, each alert in its own and the next one, so that a row is held against two cells
    and not against all that the state keeps of its service."""
    width = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {delay})")
    cell = lambda ts: F.floor(F.unix_micros(ts) / width)
    a = alerts.withWatermark("alert_ts", lateness).withColumn("cell", F.explode(F.array(cell("alert_ts"), cell("alert_ts") + 1))).alias("a")
    e = evidence.withWatermark("evidence_ts", lateness).withColumn("cell", cell("evidence_ts")).alias("e")
    near = F.expr(f"a.service = e.service AND a.cell = e.cell AND e.evidence_ts >= a.alert_ts AND e.evidence_ts <= a.alert_ts + INTERVAL {delay}")
    return a.join(e, near).select("a.alert_id", "a.service", "a.alert_ts", "e.evidence_ts", "e.value")


class CounterDelta(StatefulProcessor):
    """Delta of each counter series across micro-batches; a reset is missing. Keyed by a bucket of series: one call takes all rows of its series
    at once. State: the last time and value of each series of the bucket."""

    OUTPUT = "series_id string, ts double, delta double, issue string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "series array<string>, ts array<double>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        held = self.last.get() or ([], [], [])
        names = np.array([*held[0], *frame["series_id"]], object)
        codes, _ = pd.factorize(names, use_na_sentinel=False)
        floats = lambda x: np.array(x, float)  # noqa: E731  missing values become nan
        n, last_ts, last_value = len(held[0]), floats(held[1]), floats(held[2])
        at = np.full(len(names), -1)
        at[codes[:n]] = np.arange(n)
        order = np.lexsort((floats(frame["ts"]), codes[n:]))
        code, ts, value = codes[n:][order], floats(frame["ts"])[order], floats(frame["value"])[order]
        series = names[n:][order]
        known = at[code] >= 0
        late = np.zeros(len(code), bool)
        late[known] = ts[known] < last_ts[at[code[known]]]
        rest = np.flatnonzero(~late)
        first = np.append(True, code[rest][1:] != code[rest][:-1])[: len(rest)]
        before = np.append(np.nan, value[rest][:-1])[: len(rest)]
        carried = first & known[rest]
        before[carried] = last_value[at[code[rest][carried]]]
        has = ~first | carried
        d = value[rest] - before
        delta, issue = np.full(len(code), np.nan), np.full(len(code), None, object)
        delta[rest] = np.where(has & ~(d < 0), d, np.nan)
        issue[late] = "late"
        issue[rest[~has]] = "no_history"
        issue[rest[has & (d < 0)]] = "counter_reset"
        ends = rest[np.append(first[1:], True)[: len(rest)]]
        old = ends[known[ends]]
        last_ts[at[code[old]]], last_value[at[code[old]]] = ts[old], value[old]
        new = ends[~known[ends]]
        self.last.update(([*held[0], *series[new]], [*last_ts.tolist(), *ts[new].tolist()], [*last_value.tolist(), *value[new].tolist()]))
        yield pd.DataFrame({"series_id": series, "ts": ts, "delta": delta, "issue": issue})

    def close(self) -> None:
        pass


def median_and_mad(ordered: list[float]) -> tuple[float, float]:
    """Median and median absolute deviation of sorted numbers (nan without any): the distances from the median are two sorted runs."""
    n = len(ordered)
    if not n:
        return float("nan"), float("nan")
    mid = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    hi = bisect_left(ordered, mid)
    lo, last, now = hi - 1, 0.0, 0.0
    for _ in range(n // 2 + 1):
        last = now
        if hi == n or (lo >= 0 and mid - ordered[lo] <= ordered[hi] - mid):
            now, lo = mid - ordered[lo], lo - 1
        else:
            now, hi = ordered[hi] - mid, hi + 1
    return mid, now if n % 2 else (last + now) / 2


class HealthyBuffer(StatefulProcessor):
    """Score of each value against the last ``size`` healthy ones of its key, then the buffer's update. State: a bounded list."""

    OUTPUT = "key string, ts double, ready boolean, score double"

    def __init__(self, size: int = 20, least: int = 3, healthy_below: float = 3.0, floor: float = 1.0, cap: float = 8.0):
        self.size, self.least, self.below, self.floor, self.cap = size, least, healthy_below, floor, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        values = deque(state[0] if state is not None else [], self.size)
        inside = sorted(x for x in values if x == x)  # the held values that are numbers, in order
        frame = pd.concat(list(rows)).sort_values("ts")
        readies, scores = [], []
        for value in frame["value"].astype(float).tolist():
            ready = len(values) >= self.least
            score = None
            if ready:
                mid, spread = median_and_mad(inside)
                score = min(max((value - mid) / max(1.4826 * spread, self.floor), 0.0), self.cap)
            readies.append(ready)
            scores.append(score)
            if score is None or score < self.below:
                if len(values) == self.size and (gone := values[0]) == gone:
                    del inside[bisect_left(inside, gone)]
                values.append(value)
                if value == value:
                    insort(inside, value)
        self.held.update((list(values),))
        yield pd.DataFrame({"key": key[0], "ts": frame["ts"].astype(float).to_numpy(), "ready": np.array(readies, bool), "score": np.array(scores, float)})

    def close(self) -> None:
        pass


class AlertMachine(StatefulProcessor):
    """The alert states of alerts.state_machine across micro-batches, one row in for each window of a key."""

    OUTPUT = "key string, at double, score double, state string"

    def __init__(self, soft: float, hard: float, soft_n: int, hard_n: int, recover_n: int, cooldown: int):
        self.rule = (soft, hard, soft_n, hard_n, recover_n, cooldown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, s int, h int, calm int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        soft, hard, soft_n, hard_n, recover_n, cooldown = self.rule
        state, s, h, calm = self.now.get() or ("healthy", 0, 0, 0)
        out = []
        frame = pd.concat(list(rows)).sort_values("at")
        for at, score in zip(frame["at"], frame["score"]):
            s, h, calm = (s + 1 if score >= soft else 0), (h + 1 if score >= hard else 0), (calm + 1 if score < soft else 0)
            if h >= hard_n:
                state = "hard"
            elif state == "hard":
                state = "recovery" if calm >= recover_n else "hard"
            elif state == "recovery":
                state = "healthy" if calm >= recover_n + cooldown else "recovery"
            elif s >= soft_n:
                state = "soft"
            elif state == "soft":
                state = "healthy" if calm >= 1 else "soft"
            else:
                state = "healthy"
            out.append((key[0], float(at), float(score), state))
        self.now.update((state, s, h, calm))
        yield pd.DataFrame(out, columns=["key", "at", "score", "state"])

    def close(self) -> None:
        pass


class LateSplit(StatefulProcessor):
    """Rows of windows older than the newest seen window minus ``allowed`` are marked late instead of being dropped."""

    OUTPUT = "key string, win long, value double, late boolean"

    def __init__(self, allowed: int):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "win long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        state = self.top.get()
        top = state[0] if state is not None else None
        late = [top is not None and w < top - self.allowed for w in frame["win"]]
        self.top.update((int(max([*frame["win"], *([top] if top is not None else [])])),))
        yield pd.DataFrame({"key": key[0], "win": frame["win"].astype(int), "value": frame["value"], "late": late})

    def close(self) -> None:
        pass


class RecursiveFit(StatefulProcessor):
    """Recursive least squares of a target over array features across micro-batches. State: coefficients and covariance."""

    OUTPUT = "target string, ts double, predicted double, residual double"

    def __init__(self, forgetting: float = 0.98, start: float = 100.0):
        self.forgetting, self.start = forgetting, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "theta array<double>, p array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts")
        state = self.model.get()
        n = len(frame["x"].iloc[0])
        theta = np.zeros(n) if state is None else np.array(state[0])
        p = np.eye(n) * self.start if state is None else np.array(state[1]).reshape(n, n)
        out = []
        for ts, y, x in zip(frame["ts"], frame["y"], frame["x"]):
            x = np.asarray(x, float)
            guess = float(theta @ x)
            out.append((key[0], float(ts), guess, float(y - guess)))
            gain = p @ x / (self.forgetting + x @ p @ x)
            theta = theta + gain * (y - guess)
            p = (p - np.outer(gain, x @ p)) / self.forgetting
        self.model.update((theta.tolist(), p.ravel().tolist()))
        yield pd.DataFrame(out, columns=["target", "ts", "predicted", "residual"])

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """The stream through a processor, grouped by key. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    return stream.groupBy(key).transformWithStateInPandas(processor, processor.OUTPUT, "append", "none")


def drained(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there in micro-batches and stop; a restart goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def idle_windows(rows: DataFrame, key: str, win: str, components: DataFrame) -> DataFrame:
    """Batch form of idle windows: every window between a key's first and last one, with an issue for each missing component."""
    span = rows.groupBy(key).agg(F.min(win).alias("a"), F.max(win).alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", "b")).alias(win)).join(components)
    have = rows.select(key, win, "component").distinct().withColumn("_have", F.lit(True))
    return grid.join(have, [key, win, "component"], "left").withColumn("issue", F.when(F.col("_have").isNull(), "missing_component")).drop("_have")


class ServiceLearner(StatefulProcessor):
    """learner.learn across micro-batches: FEATURES rows in, RESULT rows out. State of a target: its features, coefficients, covariance and counters."""

    OUTPUT = L.RESULT

    def __init__(self, **rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "keys array<string>, theta array<double>, p array<double>, updates int, since int, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        model = L.TargetModel(**self.rule, state=self.model.get())
        frame = L.plain(pd.concat(list(rows)).sort_values("win"))
        out = L.as_result([model.step(row) for row in frame.itertuples(index=False)])
        self.model.update(model.state())
        yield out

    def close(self) -> None:
        pass
