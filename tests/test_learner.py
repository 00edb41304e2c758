"""Propagation models that follow the topology: batch, stream and a plain loop agree through changes, breaks and gates."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import learner as L
from faultline.plans import streams
from faultline.streaming import windows as W

LAGS, QUALITY, GAP = [1, 2], 0.5, 1
RULE = {"forgetting": 0.95, "start": 50.0, "least_updates": 3, "least_since": 2}
#: Topologies by window: c comes in the second one and is gone in the third, which also turns an edge round; the fourth equals the first.
TOPOLOGIES = {"t0": ("ab", ["ab"]), "t1": ("abc", ["ab", "cb"]), "t2": ("ab", ["ba"]), "t3": ("ab", ["ba"]), "t4": ("abc", ["ab", "cb"])}
SPANS = {"t0": range(0, 8), "t1": range(8, 16), "t2": range(16, 20), "t3": range(20, 24), "t4": range(24, 34)}
MISSING = {12, 13, 28}


def data():
    rng = random.Random(3)
    states, gates, windows = [], [], []
    for name, span in SPANS.items():
        for win in span:
            if win in MISSING:
                continue
            windows.append((win, name))
            gates.append((win, rng.random() < 0.8))
            for s in TOPOLOGIES[name][0]:
                if rng.random() < 0.97:
                    states.append((s, win, rng.gauss(0, 1), rng.random() < 0.98, rng.choice([0.4] + [0.9] * 19)))
    return states, gates, windows


def plain(states, gates, windows):
    """The same in one loop over windows, with dictionaries for history and models."""
    by = {(s, w): (v, r, q) for s, w, v, r, q in states}
    gate, out, issues = dict(gates), {}, []
    history, models, last, structure = set(), {}, None, None
    for win, name in windows:
        services, edges = TOPOLOGIES[name]
        if last is not None and win - last > GAP:
            history.clear()
            issues.append((win, "*", "history_gap"))
        if (services, edges) != structure:
            issues.append((win, "*", "topology_configured" if structure is None else "topology_reconfigured"))
            issues += [(win, s, "service_archived") for s in models if s not in services]
            new = {}
            for t in services:
                keys = [(p, k) for p in sorted({t, *(e[0] for e in edges if e[1] == t)}) for k in LAGS]
                old = models.get(t, {"theta": {}, "p": {}, "n": 0})
                theta = {k: old["theta"].get(k, 0.0) for k in keys}
                cov = {(a, b): old["p"].get((a, b), RULE["start"] if a == b else 0.0) if (a in old["theta"] and b in old["theta"]) else (RULE["start"] if a == b else 0.0) for a in keys for b in keys}
                new[t] = {"keys": keys, "theta": theta, "p": cov, "n": old["n"], "since": 0}
            models, structure = new, (services, edges)
        for t in sorted(models):
            m = models[t]
            why = x = None
            values = []
            for p, k in m["keys"]:
                s = by.get((p, win - k))
                why = why or ("insufficient_history" if win - k not in history else "missing_parent_state" if s is None else "baseline_not_ready" if not s[1] else "low_observation_quality" if s[2] < QUALITY else None)
                values.append(s and s[0])
            if (t, win) not in by:
                why = "missing_target"
            if why:
                issues.append((win, t, why))
                continue
            x, (y, ready, quality) = np.array(values), by[t, win]
            theta, cov = np.array([m["theta"][k] for k in m["keys"]]), np.array([[m["p"][a, b] for b in m["keys"]] for a in m["keys"]])
            reason = "update_gate_closed" if not gate[win] else "baseline_not_ready" if not ready else "low_observation_quality" if quality < QUALITY else None
            guess = theta @ x
            if reason is None:
                gain = cov @ x / (RULE["forgetting"] + x @ cov @ x)
                theta, cov = theta + gain * (y - guess), (np.eye(len(x)) - np.outer(gain, x)) @ cov / RULE["forgetting"]
                m["theta"], m["p"] = dict(zip(m["keys"], theta)), {(a, b): cov[i, j] for i, a in enumerate(m["keys"]) for j, b in enumerate(m["keys"])}
                m["n"], m["since"] = m["n"] + 1, m["since"] + 1
            out[t, win] = (guess, y, m["n"] >= RULE["least_updates"] and m["since"] >= RULE["least_since"], reason)
        history.add(win)
        last = win
    return out, sorted(issues)


@pytest.fixture(scope="module")
def frames(spark):
    states, gates, windows = data()
    s = spark.createDataFrame(states, "service string, win long, value double, ready boolean, quality double")
    services = spark.createDataFrame([(n, x) for n, (t, _) in TOPOLOGIES.items() for x in t], "snapshot_id string, service string")
    edges = spark.createDataFrame([(n, e[0], e[1]) for n, (_, es) in TOPOLOGIES.items() for e in es], "snapshot_id string, parent string, target string")
    versions = L.topology_versions(spark.createDataFrame(windows, "win long, snapshot_id string"), services, edges)
    features = L.feature_rows(s, versions, services, edges, spark.createDataFrame(gates, "win long, learns boolean"), LAGS, QUALITY, GAP)
    return versions, services, features.cache(), plain(states, gates, windows)


def seen(rows):
    return {(r.target, r.win): (r.predicted, r.actual, r.ready, r.reason) for r in rows if r.predicted is not None}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][2:] == want[k][2:] and np.allclose(got[k][:2], want[k][:2], rtol=1e-9, atol=1e-9)


def test_equal_structures_are_one_version(frames):
    assert {r.snapshot_id: r.version for r in frames[0].collect()} == {"t0": 0, "t1": 1, "t2": 2, "t3": 2, "t4": 3}


def test_batch_equals_a_plain_loop(frames):
    rows = L.learn(frames[2], **RULE).collect()
    same(seen(rows), frames[3][0])
    for r in rows:
        if r.predicted is not None:
            assert abs(sum(c.part for c in r.contributions) - r.predicted) < 1e-9 and [c.feature for c in r.contributions] == sorted(c.feature for c in r.contributions)


def test_issues_name_breaks_changes_and_archived_services(frames):
    versions, services, features, (_, want) = frames
    assert sorted((r.win, r.target, r.issue) for r in L.window_issues(features, versions, services, GAP).collect()) == want
    assert {i for _, _, i in want} >= {"history_gap", "topology_reconfigured", "service_archived", "missing_target", "insufficient_history", "missing_parent_state"}


def test_a_service_that_comes_back_begins_afresh(frames):
    rows = {(r.target, r.win): r for r in L.learn(frames[2], **RULE).collect()}
    first = min(w for t, w in rows if t == "c" and w >= 24 and rows[t, w].predicted is not None)
    assert all(c.coefficient == 0.0 for c in rows["c", first].contributions)
    carried = min(w for t, w in rows if t == "b" and w >= 24 and rows[t, w].predicted is not None)
    parts = {c.feature: c.coefficient for c in rows["b", carried].contributions}
    assert parts["b@1"] != 0.0 and parts["c@1"] == 0.0


def test_stream_equals_batch_through_restarts(spark, frames):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STORE)
    try:
        rows = frames[2].withColumn("ord", F.col("win"))
        out = streams.replayed(SimpleNamespace(spark=spark), rows, lambda stream: W.stateful(stream.drop("ord"), "target", W.ServiceLearner(**RULE)))
        same(seen(out.collect()), frames[3][0])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_no_states_give_no_rows(spark, frames):
    versions, services, *_ = frames
    none = spark.createDataFrame([], "service string, win long, value double, ready boolean, quality double")
    edges = spark.createDataFrame([], "snapshot_id string, parent string, target string")
    rows = L.learn(L.feature_rows(none, versions, services, edges, spark.createDataFrame([], "win long, learns boolean"), LAGS, QUALITY, GAP)).collect()
    assert rows and {r.reason for r in rows} == {"missing_target"}
