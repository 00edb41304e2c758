"""Model lifecycles against a plain cache, and how candidates are told apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import diagnosis as D
from faultline.operators import lifecycle as M

NEXT = {"healthy": ("soft", "hard"), "soft": ("healthy", "hard"), "hard": ("recovery",), "recovery": ("healthy", "hard")}


def events(seed):
    rng, out = random.Random(seed), []
    for service in "ab":
        state = "healthy"
        for i in range(120):
            state = rng.choice(NEXT[state])
            out.append((service, 10 * i + rng.randrange(9), state, rng.choice("xxyzw")))
    return out


def plain(rows, cache):
    """One loop with an ordered cache for each service."""
    out, held, active, before, fits = [], {}, {}, {}, {}
    for service, win, state, fp in sorted(rows):
        c = held.setdefault(service, {})
        if state in ("soft", "hard"):
            a = active.get(service)
            if state == "soft":
                action = "prepare_cached" if fp in c else "prepare"
            elif before.get(service) in ("soft", "recovery"):
                action = "freeze" if a[0] == fp else "rebuild"
            else:
                action = "freeze_unprepared"
            if action in ("prepare", "rebuild", "freeze_unprepared"):
                fits.setdefault((service, fp), []).append(win)
            c.pop(fp, None)
            c[fp] = True
            while len(c) > cache:
                c.pop(next(iter(c)))
            active[service] = (fp, fits[service, fp][-1], len(fits[service, fp]))
            status = "PREPARED" if state == "soft" else "FROZEN"
        else:
            action, status = ("recover", "RECOVERED") if state == "recovery" else ("archive", "ARCHIVED") if before.get(service) == "soft" else ("close", "RECOVERED")
        before[service] = state
        out.append((service, win, state, *((active[service][0],) if service in active else (None,)), action, status, *(active[service][1:] if service in active else (None, None))))
    return out


@pytest.mark.parametrize("seed,cache", [(1, 2), (2, 1), (3, 3), (4, 8)])
def test_transitions_equal_a_plain_cache(spark, seed, cache):
    rows = events(seed)
    got = M.transitions(spark.createDataFrame(rows, "service string, win long, state string, fingerprint string").repartition(3), cache)
    names = ["service", "win", "state", "fingerprint", "action", "status", "fitted_at", "version"]
    want = plain(rows, cache)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
    assert {w[4] for w in want} >= {"prepare", "freeze", "archive", "recover", "close", "rebuild", "freeze_unprepared"}


def test_a_fit_learns_from_healthy_windows_before_it_alone(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.random(), rng.choice(["healthy", "healthy", "hard"])) for i in range(30)]
    got = {r.win: r for r in M.trained(spark.createDataFrame(rows, "service string, win long, score double, state string")).collect()}
    for k in range(30):
        pairs = [(rows[i - 1][2], rows[i][2]) for i in range(1, k) if rows[i][3] == "healthy"]
        assert got[k].rows == len(pairs) and got[k].ready == (len(pairs) >= 10)
        if pairs:
            x, y = np.array(pairs).T
            slope = ((x - x.mean()) * (y - y.mean())).sum() / (((x - x.mean()) ** 2).sum() + 1)
            assert abs(got[k].slope - slope) < 1e-9 and abs(got[k].intercept - (y.mean() - slope * x.mean())) < 1e-9


def test_a_lone_candidate_is_sure_and_twins_are_not(spark):
    gains = spark.createDataFrame([("s", 1, "a", 0, 4.0), ("t", 1, "a", 0, 4.0), ("t", 1, "b", 1, 4.0)], "service string, win long, root_service string, hop int, gain double")
    signature = spark.createDataFrame([(r, 1, m, x) for r in "ab" for m, x in (("p", 3.0), ("q", 3.0), ("r", 0.0))], "root_service string, win long, metric string, x double")
    quality = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.5)], "root_service string, win long, quality double")
    got = {(r.service, r.root_service): r for r in D.told_apart(gains, signature, quality).collect()}
    alone, twin = got["s", "a"], got["t", "a"]
    assert (alone.cf, alone.margin, alone.path, alone.coherence) == (1.0, 1.0, 1.0, 0.0) and abs(alone.entropy - 1.0) < 1e-12
    assert abs(alone.identifiability - 0.7) < 1e-9 and abs(alone.confidence - (0.4 + 0.2 + 0.2 + 0.2 * 0.7)) < 1e-9
    assert twin.margin == 0.0 and abs(twin.coherence - 1.0) < 1e-9 and twin.identifiability < 0.1 and got["t", "b"].path == 0.5


def test_types_and_alert_scores_by_table(spark):
    names = ["CPU stress", "network-delay", "dns", "inet", "futex wait", "Storage", "disk i/o", "disk-io", "radio", "memory_leak", "high load", "cpu net", "", None, "Other"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(S.canonical_type(F.col("n"))).collect()]
    assert got == ["CPU", "network", "dns", "network", "lock contention", "storage I/O", "storage I/O", "storage I/O", "radio", "memory", "load", "CPU", "", "", "other"]
    cases = [("request.p99_latency_ms", 2.0, 4.0), ("request.p99_latency_ms", -2.0, 0.0), ("request.rps", -2.0, 2.4), ("request.p50_latency_ms", 2.0, 2.4), ("net.retrans", 2.0, 1.6), ("x", 2.0, 2.0)]
    rows = spark.createDataFrame([c[:2] for c in cases], "m string, z double").select(S.alert_score(F.col("m"), F.col("z"))).collect()
    assert [round(r[0], 9) for r in rows] == [c[2] for c in cases]
