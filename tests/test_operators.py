"""Operators against hand-computed values and closed forms."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import aggregation as A
from faultline.operators import alerts as L
from faultline.operators import baselines as B
from faultline.operators import diagnosis as D
from faultline.operators import evidence as E
from faultline.operators import inversion as I
from faultline.operators import propagation as P
from faultline.operators import topology as T
from faultline.operators import validation as V
from faultline.sources import records as R


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_counter_delta_and_resets(spark):
    df = rows(spark, [("a", 1.0, 5.0), ("a", 2.0, 9.0), ("a", 3.0, 2.0), ("b", 1.0, 1.0)], "s string, ts double, value double")
    assert values(A.counter_delta(df, "s", ["ts"]).fillna({"issue": ""}).fillna({"delta": -1.0}), "s", "ts", "delta", "issue") == [
        ("a", 1.0, -1.0, "no_history"), ("a", 2.0, 4.0, ""), ("a", 3.0, -1.0, "counter_reset"), ("b", 1.0, -1.0, "no_history"),
    ]
    assert values(A.counter_delta(df, "s", ["ts"], "current").where("issue = 'counter_reset'"), "delta") == [(2.0,)]


def test_histogram_quantile_cases(spark):
    inf = float("inf")
    data = [("a", 1.0, 2), ("a", 2.0, 9), ("a", inf, 10), ("b", 1.0, 0), ("b", inf, 4), ("c", 1.0, 0), ("c", inf, 0), ("d", 1.0, 5), ("d", inf, 3)]
    got = {r.k: (r.value, r.issue) for r in A.histogram_quantile(rows(spark, data, "k string, le double, cum_count long"), ["k"], 0.9).collect()}
    assert got["a"] == (2.0, None) and got["b"] == (1.0, "above_last_bound") and got["c"] == (0.0, "empty") and got["d"][1] == "not_monotone"


def test_safe_ratio(spark):
    df = rows(spark, [(0, 0), (1, 0), (1, 2), (3, 2)], "n int, d int")
    v, s = A.safe_ratio(F.col("n"), F.col("d"), bounded=True)
    assert [r.s for r in df.select(s.alias("s")).collect()] == ["no_coverage", "no_denominator", "ok", "above_one"]
    assert df.select(v.alias("v")).collect()[2].v == pytest.approx(0.5)


def test_plan_order_and_cycles(spark):
    base = rows(spark, [(1,)], "x int")
    got = A.run_plan({"b": (["a"], lambda a: a.withColumn("x", F.col("x") * 10)), "a": (["in"], lambda d: d.withColumn("x", F.col("x") + 1))}, {"in": base})
    assert got["b"].first().x == 20
    with pytest.raises(ValueError):
        A.run_plan({"a": (["b"], None), "b": (["a"], None)}, {})


def test_streaks_reset(spark):
    df = rows(spark, [("a", i, v) for i, v in enumerate([1, 5, 5, 0, 5])], "k string, t int, v int")
    assert [s for _, s in values(L.streaks(df, ["k"], ["t"], F.col("v") > 3), "t", "streak")] == [0, 1, 2, 0, 1]


def test_state_machine_path(spark):
    scores = [0, 4, 4, 7, 7, 0, 0, 0, 0, 4, 4]
    df = rows(spark, [("k", float(i), float(s)) for i, s in enumerate(scores)], "k string, t double, score double")
    got = [s for _, s in values(L.state_machine(df, "k", "t", 3.0, 6.0, 2, 2, 2, 1), "at", "state")]
    assert got == ["healthy", "healthy", "soft", "soft", "hard", "hard", "recovery", "healthy", "healthy", "healthy", "soft"]
    shuffled = L.state_machine(df.repartition(3).orderBy(F.rand(1)), "k", "t", 3.0, 6.0, 2, 2, 2, 1)
    assert [s for _, s in values(shuffled, "at", "state")] == got


def test_alert_windows_merge(spark):
    df = rows(spark, [(i, t, "s", "m", 1.0, "soft") for i, t in enumerate([0.0, 80.0, 171.0, 400.0])], "event_id int, timestamp double, service string, metric string, z_score double, severity string")
    w = L.window_summary(L.alert_windows(df))
    assert values(w, "window_no", "start_ts", "end_ts", "event_count") == [(1, -30.0, 140.0, 2), (2, 141.0, 231.0, 1), (3, 370.0, 460.0, 1)]


def test_alert_windows_over_cells_and_keys(spark):
    """Numbers equal those of one ordered walk, whatever the cells, for ties, repeats, null keys and null times."""
    rng = random.Random(5)
    data = [(i, rng.choice([-4000.0, 0.0, 9000.0]) + rng.randrange(40) * 45.0, rng.choice(["a", "b", None])) for i in range(120)] + [(500, None, "a")]
    df = rows(spark, data + data[:3], "event_id int, timestamp double, cluster string")
    for by in ([], ["cluster"]):
        want, last, no = [], {}, {}
        for i, t, k in sorted((r for r in data + data[:3] if r[1] is not None), key=lambda r: r[1]):
            k = k if by else "all"
            no[k] = no.get(k, 0) + (k not in last or t - 30.0 > last[k] + 60.0)
            last[k] = t
            want.append((i, no[k]))
        for cell in (60.0, 3600.0):
            assert values(L.alert_windows(df, by=by, cell=cell), "event_id", "window_no") == sorted(want)
    plan = L.alert_windows(df)._jdf.queryExecution().toString()
    assert plan.count("_cell") and L.alert_windows(df.limit(0)).count() == 0


def test_robust_stats_fall_back(spark):
    """Clean rows of the instance, any of the instance, clean ones of the service, any of the service; before the incident only."""
    cols = "timestamp double, service string, instance string, metric string, value double, incident_id string"
    m = rows(spark, [(float(t), s, i, "m", v, inc) for t, s, i, v, inc in [
        (1, "s", "a", 1.0, None), (2, "s", "a", 3.0, None), (3, "s", "a", 50.0, "x"), (9, "s", "a", 99.0, None),
        (1, "s", "b", 7.0, "x"), (2, "s", "b", 9.0, "x"), (8, "s", "c", 4.0, None), (1, "t", "d", 5.0, "x"), (8, "t", "e", 6.0, None), (8, "u", "f", 6.0, None)]], cols)
    stats = B.robust_stats(m, rows(spark, [("i", 5.0), ("early", 0.0)], "incident_id string, start_ts double"))
    assert values(stats, "incident", "instance", "median", "mad", "baseline_count") == [
        ("i", "a", 2.0, 1.0, 2), ("i", "b", 8.0, 1.0, 2), ("i", "c", 2.0, 1.0, 2), ("i", "d", 5.0, 0.0, 1), ("i", "e", 5.0, 0.0, 1),
    ]


def test_robust_scores(spark):
    df = rows(spark, [("a", float(i), float(v)) for i, v in enumerate([1, 2, 3, 4, 100, 7])], "k string, ts double, value double")
    got = dict(values(B.prefix_z(df, ["k"], ["ts"], ratio=0.5), "ts", "z_score"))
    assert got[4.0] == pytest.approx((100 - 2) / 1.4826, rel=1e-6)
    s = B.scale_choice(rows(spark, [("a", v) for v in (1.0, 1.0, 1.0, 1.0, 9.0, 9.0)], "k string, value double"), ["k"], 0.5).first()
    assert s.scale_source == "iqr"
    assert B.prefix_z(df.limit(2), ["k"], ["ts"]).count() == 0


def test_point_in_time_edges(spark):
    snaps = rows(spark, [("a", 0.0, 10.0), ("b", 10.0, 20.0), ("c", 15.0, 20.0)], "snapshot_id string, valid_from double, valid_to double")
    got = {r.q: (r.snapshot_id, r.issue) for r in T.point_in_time(rows(spark, [(1, 10.0), (2, 25.0), (3, 16.0), (4, 9.9)], "q int, t double"), snaps, "t", bucket=7.0).collect()}
    assert got[1] == ("b", None) and got[2] == (None, "no_snapshot") and got[3][1] == "several_snapshots" and got[4][0] == "a"


def test_hops_and_paths(spark):
    edges = rows(spark, [("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 1.0), ("a", "c", 0.1)], "src string, dst string, weight double")
    assert values(T.hops(rows(spark, [("a",)], "seed string"), edges, 3), "node", "hop") == [("a", 0), ("b", 1), ("c", 1)]
    assert values(T.simple_paths(rows(spark, [("a",)], "seed string"), edges, 3).withColumn("p", F.concat_ws(">", "path")), "p", "score") == [("a>b", 0.5), ("a>b>c", 0.25), ("a>c", 0.1)]


def test_impact_rules(spark):
    calls = rows(spark, [("a", "b", "call"), ("b", "c", "trace"), ("x", "y", "none")], "src string, dst string, edge_type string")
    rules = rows(spark, [("call", "reverse"), ("trace", "both"), ("none", "none")], "edge_type string, direction string")
    assert values(T.impact_edges(calls, rows(spark, [("c", "b")], "src string, dst string"), rules), "src", "dst", "origin") == [("b", "a", "rule"), ("b", "c", "rule"), ("c", "b", "explicit")]


def test_budget_skips_what_does_not_fit(spark):
    df = rows(spark, [("w", "a", 10.0, 5.0), ("w", "b", 6.0, 4.0), ("w", "c", 1.0, 1.0)], "w string, probe string, gain double, cost double")
    assert values(E.within_budget(df, "w", 6.0), "probe", "spent") == [("a", 6.0), ("c", 6.0)]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("probability", F.lit(0.3))
    a, b = E.sampled(df.repartition(1), "id"), E.sampled(df.repartition(7), "id")
    assert values(a, "id", "observed") == values(b, "id", "observed")
    assert 30 < a.where("observed").count() < 90


def test_noisy_or_and_shrink(spark):
    r = spark.range(1).select(S.noisy_or(F.array(F.lit(0.5), F.lit(0.5))).alias("n"), S.soft_threshold(F.lit(-3.0), 1.0).alias("t"), S.canonical_type(F.lit(" Disk-IO ")).alias("c"), S.ipw_weight(F.lit(0.01)).alias("w")).first()
    assert (r.n, r.t, r.c, r.w) == (0.75, -2.0, "storage I/O", 20.0)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=30) * 0.1
    data = [("t", float(i), float(y[i]), f"f{j}", float(x[i, j])) for i in range(30) for j in range(3)]
    df = rows(spark, data, "target string, ts double, y double, feature string, x double")
    got = [c for _, c in values(P.ridge(P.gram(df), 1.0), "feature", "coefficient")]
    assert got == pytest.approx(np.linalg.solve(x.T @ x + np.eye(3), x.T @ y).tolist())
    pred = P.predict(df, P.ridge(P.gram(df), 1.0)).orderBy("ts").collect()
    assert [r.predicted for r in pred] == pytest.approx((x @ got).tolist())
    last = P.recursive(df, forgetting=1.0, start=1.0).orderBy("ts").collect()[-1]
    theta = np.linalg.solve(x[:29].T @ x[:29] + np.eye(3), x[:29].T @ y[:29])
    assert last.predicted == pytest.approx(float(theta @ x[29]))


def test_graph_inversion_is_optimal():
    rng = np.random.default_rng(1)
    r, d = rng.normal(size=6) * 2, np.zeros((3, 6))
    for i, (a, b) in enumerate([(0, 1), (2, 3), (4, 5)]):
        d[i, a], d[i, b] = 1, -1
    groups = [np.arange(3), np.arange(3, 6)]
    x, _ = I.admm(r, d, groups, 0.3, 0.08, 0.2, 3000)
    f = lambda v: 0.5 * ((r - v) ** 2).sum() + 0.3 * np.abs(v).sum() + 0.08 * np.abs(d @ v).sum() + 0.2 * sum(np.linalg.norm(v[g]) for g in groups)
    assert all(f(x) <= f(x + rng.normal(size=6) * s) + 1e-5 for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_group_solve_is_optimal(spark):
    df = rows(spark, [("a", [2.0, -1.0, 0.4], [1.0, 0.5, 1.0], 0.0), ("b", [0.1, 0.05, 0.0], [1.0, 1.0, 1.0], 0.0)], "g string, r array<double>, q array<double>, h double")
    got = {x.g: np.array(x.theta) for x in I.group_solve(df, ["g"], rounds=400).collect()}
    r, q = np.array([2.0, -1.0, 0.4]), np.array([1.0, 0.5, 1.0])
    f = lambda v: 0.5 * (q * (v - r) ** 2).sum() + 0.15 * v.sum() + 0.25 * np.linalg.norm(v)
    rng = np.random.default_rng(0)
    assert all(f(got["a"]) <= f(np.maximum(got["a"] + rng.normal(size=3) * 0.05, 0)) + 1e-6 for _ in range(50))
    assert got["b"].tolist() == [0.0, 0.0, 0.0]


def test_weighted_solver_reaches_a_stationary_point():
    import pandas as pd

    rng = np.random.default_rng(0)
    a = rng.normal(size=(8, 4))
    frame = pd.DataFrame({"incident_id": ["i"], "r": [rng.normal(size=8)], "w": [np.ones(8)], "a": [a.ravel()], "l1": [np.full(4, 0.1)], "blocks": [np.array([0, 0, 1, 1])], "group": [0.1]})
    out = next(I.fista(iter([frame]))).iloc[0]
    x, r = np.array(out["x"]), np.asarray(frame["r"][0])
    f = lambda v: 0.5 * ((a @ v - r) ** 2).sum() + 0.1 * np.abs(v).sum() + 0.1 * (np.linalg.norm(v[:2]) + np.linalg.norm(v[2:]))
    assert f(x) == pytest.approx(out["objective"]) and all(f(x) <= f(x + rng.normal(size=4) * 0.01) + 1e-7 for _ in range(50))


def test_hits_and_positions(spark):
    labels = rows(spark, [("i", "a"), ("j", "b"), ("k", "z")], "incident_id string, root string")
    ranked = rows(spark, [("i", ["a", "b"]), ("j", ["a", "b"]), ("k", ["a"])], "incident_id string, ranked array<string>")
    r = D.hits(D.positions(labels, ranked, F.col("root"))).first()
    assert (r.hit1, r.hit3, r.mrr) == (pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(0.5))


def test_exposition_and_envelopes(spark):
    text = ['# HELP x y', 'up{job="a\\"b",pod="p"} 3.5 1700', "plain 4", "bad{ 1"]
    p = R.exposition(F.col("value"))
    got = rows(spark, [(t,) for t in text], "value string").select(*[c.alias(k) for k, c in p.items()]).collect()
    assert [r.name for r in got] == [None, "up", "plain", None]
    assert got[1].labels == {"job": 'a"b', "pod": "p"} and (got[1].value, got[1].ts_ms, got[2].ts_ms) == (3.5, 1700, None)
    log = R.enveloped("m", rows(spark, [(1, "x")], "a int, b string"))
    assert json.loads(log.first().value) == {"record_type": "m", "record": {"a": 1, "b": "x"}}
    assert R.routed(log, "m", "a int, b string").collect()[0].b == "x" and R.routed(log, "other", "a int").count() == 0


def test_jsonl_and_tables(spark, tmp_path):
    df = rows(spark, [(1.0, "s", "i", "n", "m", 2.0, "t", None)], R.METRIC)
    R.write_jsonl(df, str(tmp_path / "j"))
    assert R.read_jsonl(spark, str(tmp_path / "j"), R.METRIC).collect() == df.collect()
    R.write_table(df, str(tmp_path / "t"), R.METRIC)
    with pytest.raises(Exception):
        R.write_table(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        R.write_table(df.drop("node"), str(tmp_path / "u"), R.METRIC)
    (tmp_path / "bad").write_text("{not json\n")
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "bad"), R.METRIC).collect()


def test_owner_cycles(spark):
    edges = rows(spark, [("p", "r"), ("r", "d"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {r.start: (r.owner, r.depth, r.cycle) for r in R.cgroup_owner(rows(spark, [("p",), ("x",), ("q",)], "start string"), edges).collect()}
    assert got == {"p": ("d", 2, False), "x": ("y", 1, True), "q": ("q", 0, False)}


def test_validation_rules(spark):
    df = rows(spark, [("a.b.c", "a", "b.c"), ("z.b", "a", "b"), ("bad", "a", "b")], "node string, service string, metric string")
    assert [r.issue for r in V.ownership(df, "node", "service", "metric").collect()] == [None, "service_mismatch", "bad_node"]
    payload = rows(spark, [('{"a": {"Root-Service": 1}}',), ('{"service": 1}',)], "p string")
    assert [r.l for r in payload.select(V.leaks(F.col("p"), ("root_service",)).alias("l")).collect()] == [True, False]
    assert values(V.with_reasons(spark.range(3), {"even": F.col("id") % 2 == 0}).withColumn("r", F.array_join("reasons", ",")), "id", "r") == [(0, ""), (1, "even"), (2, "")]
