"""Blind reruns and the sources and rules that came with them."""

import random

from pyspark.sql import functions as F

from faultline.operators import rerun as R
from faultline.operators import validation as V
from faultline.sources import records as Q


def table(spark):
    rng, out = random.Random(9), []
    for t in range(200):
        for s in "ab":
            for m in ("cpu.throttled_usec", "net.retrans"):
                hot = 8.0 if (s, m) == ("a", "net.retrans") and 100 <= t < 110 or (s, m) == ("b", "cpu.throttled_usec") and 150 <= t < 160 else 0.0
                v = rng.gauss(5, 1) + hot
                out.append((s, m, float(t), v, (v - 5), 1.0))
    return out, spark.createDataFrame(out, "service string, metric string, timestamp double, value double, residual double, probability double").repartition(5)


def test_near_rows_equal_a_range_join(spark):
    rows, df = table(spark)
    windows = [("i", 100.0, 110.0), ("j", 0.0, 3.0), ("k", 105.0, 300.0)]
    got = R.near(df, spark.createDataFrame(windows, "incident_id string, start_ts double, end_ts double"), 30.0, 7.0)
    want = sorted((i, s, m, t) for i, a, b in windows for s, m, t, *_ in rows if a - 30 <= t <= b)
    assert sorted((r.incident_id, r.service, r.metric, r.timestamp) for r in got.collect()) == want


def test_each_run_finds_its_own_root_without_labels(spark):
    _, df = table(spark)
    windows = spark.createDataFrame([("r1", "r1/1", 100.0, 109.0), ("r2", "r2/1", 150.0, 159.0)], "run_id string, incident_id string, start_ts double, end_ts double")
    got = R.rerun(df, windows, 40.0, 10.0).where("semantic_rank = 1").collect()
    assert {(r.run_id, r.service, r.metric) for r in got} == {("r1", "a", "net.retrans"), ("r2", "b", "cpu.throttled_usec")}
    assert all(r.evidence_score == 1.0 or abs(r.evidence_score - 1) < 1e-9 for r in got)
    assert R.rerun(df, windows.limit(0), 40.0, 10.0).count() == 0


def test_conflicting_samples_count_in_no_edge(spark):
    rows = [("x", "y", 1, 2.0), ("x", "y", 1, 2.0), ("x", "y", 2, 3.0), ("x", "y", 2, 4.0), ("x", "y", 3, 5.0), ("x", "z", 4, 1.0), ("x", "z", 4, 2.0)]
    got = {r.dst: r for r in Q.call_edges(spark.createDataFrame(rows, "src string, dst string, id long, v double"), ["src", "dst"], "id", "v").collect()}
    assert (got["y"].total, got["y"].samples, got["y"].conflicts, got["y"].first_source, got["y"].last_source, got["y"].sources) == (7.0, 2, 1, 1, 3, 4)
    assert (got["z"].total, got["z"].samples, got["z"].conflicts, got["z"].first_source) == (0.0, 0, 1, None)


def test_roles_fit_by_prefix_and_source(spark):
    roles = spark.createDataFrame([("r", "a.", ["s", "t"]), ("q", "a.b", ["s"])], "role string, prefix string, sources array<string>")
    metrics = spark.createDataFrame([("a.b", "s"), ("a.b", "t"), ("a.c", "s"), ("c", "s")], "metric string, source string")
    assert {(r.metric, r.source): (r.problem, r.roles) for r in V.single_role(metrics, roles).collect()} == {("a.b", "s"): ("several_roles", ["q", "r"]), ("a.b", "t"): ("ok", ["r"]), ("a.c", "s"): ("ok", ["r"]), ("c", "s"): ("no_role", [])}


def test_written_lines_have_their_keys_in_order(spark, tmp_path):
    Q.write_jsonl(spark.createDataFrame([(1, "x", 2.0)], "b int, c string, a double"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).select(F.col("value")).first()[0] == '{"a":2.0,"b":1,"c":"x"}'
