"""Plans and results that must hold on inputs far larger than the given ones."""

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tables_meet_rows_by_broadcast(spark):
    """A join on metric alone would put a third of all rows into one task."""
    for name in ("src_27_registry_records", "val_02_component_contract"):
        plan = plan_of(entry.queries()[name](spark, FOLDER))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_calls_are_dealt_over_partitions_of_bounded_size(spark):
    from faultline.operators.tables import spread_width

    lineitem = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    assert spread_width(lineitem) == 4 and spread_width(lineitem, 100) == -(-lineitem.count() // 100)
    for name in ("src_09_call_edges", "src_09_conflicting_samples"):
        plan = plan_of(entry.queries()[name](spark, FOLDER))
        assert "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan and "Expand" not in plan


def test_samples_without_a_value_are_no_conflict(spark):
    from faultline.sources.records import call_edges

    rows = [("x", "y", 1, None), ("x", "y", 2, 3.0), ("x", "y", 2, None), ("x", "y", 3, 4.0), ("x", "y", 3, 5.0)]
    r = call_edges(spark.createDataFrame(rows, "src string, dst string, id long, v double"), ["src", "dst"], "id", "v").first()
    assert (r.total, r.samples, r.conflicts) == (3.0, 1, 1)


def test_lift_of_many_windows_needs_no_range_join(spark):
    import random

    from faultline.operators import evidence as E

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["m", "n", None]), float(rng.randrange(4000)), rng.choice([None, *[rng.gauss(100, 30) for _ in range(9)]])) for _ in range(3000)]
    windows = [(i, 20.0 * i + 3, 20.0 * i + 9) for i in range(-1, 210)] + [(900, 0.0, 4000.0), (901, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "service string, metric string, timestamp double, value double")
    out = E.separate_lift(df, spark.createDataFrame(windows, "w long, start_ts double, end_ts double"), "w", 64.0)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    want = {}
    for w, a, b in windows:
        for s, m in {(r[0], r[1]) for r in rows}:
            of = lambda test: [v for x, y, t, v in rows if (x, y) == (s, m) and test(t)]  # noqa: B023, E731
            before, inside = of(lambda t: t < a), of(lambda t: a <= t <= b)  # noqa: B023
            mean = lambda vs: sum(v for v in vs if v is not None) / n if (n := sum(v is not None for v in vs)) else None
            if before and inside:
                want[w, s, m] = None if None in (mean(inside), mean(before)) else mean(inside) - mean(before)
    got = {(r.w, r.service, r.metric): r.absolute_lift for r in out.collect()}
    assert got.keys() == want.keys() and None in want.values()
    assert all(want[k] is x is None or abs(want[k] - x) < 1e-9 for k, x in got.items())
    assert "NestedLoop" not in plan_of(entry.queries()["evd_02_alert_window_lift"](spark, FOLDER))


class _Held:
    """A state value as Spark keeps it, without a stream."""

    def __init__(self):
        self.row = None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def _fed(processor, key, batches):
    import pandas as pd

    processor.init(_Held())
    return [pd.concat(list(processor.handleInputRows((key,), iter([b]), None)), ignore_index=True) for b in batches]


def test_one_call_takes_all_series_of_a_bucket():
    import numpy as np
    import pandas as pd

    from faultline.streaming import windows as W

    a = pd.DataFrame({"series_id": ["x", "y", "x", None, "x"], "ts": [3.0, 1.0, 1.0, 1.0, 2.0], "value": [7.0, 1.0, 5.0, 2.0, 4.0]})
    b = pd.DataFrame({"series_id": ["x", "x", "z", None], "ts": [2.5, 4.0, 9.0, 2.0], "value": [1.0, 9.0, 1.0, 5.0]})
    one, two = _fed(W.CounterDelta(), 3, [a, b])
    rows = lambda f: sorted((repr(s), t, None if np.isnan(d) else d, i) for s, t, d, i in zip(f.series_id, f.ts, f.delta, f.issue))
    assert rows(one) == [("'x'", 1.0, None, "no_history"), ("'x'", 2.0, None, "counter_reset"), ("'x'", 3.0, 3.0, None), ("'y'", 1.0, None, "no_history"), ("None", 1.0, None, "no_history")]
    assert rows(two) == [("'x'", 2.5, None, "late"), ("'x'", 4.0, 2.0, None), ("'z'", 9.0, None, "no_history"), ("None", 2.0, 3.0, None)]


def test_healthy_buffer_scores_as_medians_do_and_in_little_time():
    import random
    import time

    import numpy as np
    import pandas as pd

    from faultline.streaming import windows as W

    rng = random.Random(2)
    n = 20_000
    values = [float("nan") if i in (1, 7) else rng.choice([1.0, 2.0, rng.gauss(50, 20), rng.gauss(400, 90)]) for i in range(n)]
    frame = pd.DataFrame({"ts": [float(i) for i in range(n)], "value": values})
    start = time.time()
    got = pd.concat(_fed(W.HealthyBuffer(), "k", [frame[:500], frame[500:]]), ignore_index=True)
    assert time.time() - start < 3
    held = []
    for value, ready, score in list(zip(values, got.ready, got.score))[:1500]:
        assert ready == (len(held) >= 3)
        want = None
        if ready:
            mid = pd.Series(held).median()
            want = min(max((value - mid) / max(1.4826 * (pd.Series(held) - mid).abs().median(), 1.0), 0.0), 8.0)
            assert want == score or (np.isnan(want) and np.isnan(score))
        if want is None or want < 3.0:
            held = [*held, value][-20:]


def test_alerts_and_evidence_meet_by_time_cells(spark):
    from pyspark.sql import functions as F

    from faultline.streaming import windows as W

    at = lambda s: F.timestamp_seconds(s)
    alerts = spark.createDataFrame([(i, "s", float(t)) for i, t in enumerate([0, 3599, 3600, 7199, 7200, -1, 20000])], "alert_id long, service string, t double").select("alert_id", "service", at("t").alias("alert_ts"))
    found = spark.createDataFrame([("s", float(t), 1.0) for t in [0, 1, 3600, 7199, 7200, 10799, 14399, 14400, -7201, 13000]], "service string, t double, value double").select("service", at("t").alias("evidence_ts"), "value")
    out = W.delayed_diagnosis(alerts, found, "2 hours", "40 days")
    plan = plan_of(out)
    assert "cell" in plan.partition("Join")[2].split("Inner")[0]
    near = alerts.withColumnRenamed("service", "s").join(found, F.expr("evidence_ts >= alert_ts AND evidence_ts <= alert_ts + INTERVAL 2 hours"))
    key = lambda r: (r.alert_id, r.evidence_ts)
    assert sorted(map(key, out.collect())) == sorted(map(key, near.collect()))


def test_previous_rows_come_over_the_ends_of_time_cells(spark):
    import random

    from faultline.plans.chain import with_previous

    rng = random.Random(5)
    rows = [(i, rng.choice(["n", "m", None]), rng.choice([None, float(rng.randrange(100_000)), float(rng.randrange(3000))]), rng.choice(["a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, node string, timestamp double, service string")
    want = {}
    for k in {r[1] for r in rows}:
        last = None
        for i, _, _, s in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0.0, r[0])):
            want[i], last = last, s
    got = with_previous(df, "node", ["timestamp", "id"], "service", "before")
    assert {r.id: r.before for r in got.collect()} == want
