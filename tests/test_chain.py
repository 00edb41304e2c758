"""The chain from windows to diagnoses: stream and batch give the same, through restarts, failures before the commit and late rows."""

import random

import pytest

from faultline.operators import chain as C
from faultline.operators.tables import scratch
from faultline.streaming import chain as S
from faultline.streaming import windows as W

RULE = C.Rule(width=10.0, lateness=5.0, floor=1.0, recover_n=2, least_updates=2)


def table():
    rng, out = random.Random(8), []
    for win in range(40):
        if win in (17, 18, 19):
            continue
        for s in "abc":
            for m in ("request.p99", "cpu"):
                for k in range(2):
                    hot = 9.0 if (s, win) in {("b", 25), ("c", 26), ("a", 33), ("b", 34)} and m == "cpu" else 0.0
                    out.append((s, m, win * 10.0 + 4 * k + rng.random(), rng.gauss(5, 1) + hot))
    return sorted(out, key=lambda r: r[2])


@pytest.fixture(scope="module")
def topology(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, target string")
    reach = spark.createDataFrame([("a", "a", 0), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0), ("c", "b", 1), ("c", "a", 2)], "seed string, node string, hop int")
    return parents, reach


def schema():
    return "service string, metric string, timestamp double, value double"


def plain(df, names):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*names).collect())


NAMES = {n: [c.split()[0] for c in S.OUTPUTS[n].split(", ")] for n in ("scores", "timeline", "predictions", "reports")}


def test_stream_with_a_failure_before_its_commit_equals_batch(spark, topology):
    rows, folder, failed = table(), scratch(spark, "chain"), []

    def stop(batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    chain = S.Chain(folder, *topology, RULE, before_commit=stop)
    for part in (rows[:150], rows[150:260], rows[260:]):
        spark.createDataFrame(part, schema()).write.mode("append").parquet(f"{folder}-in")
        for again in range(2):
            stream = spark.readStream.schema(schema()).parquet(f"{folder}-in")
            try:
                W.drained(stream, f"{folder}-checkpoint", chain)
                break
            except Exception as error:
                assert "lost" in str(error) and again == 0
                assert S.committed(spark, folder) == [0]
    chain.finish(spark)
    assert failed == [1] and S.committed(spark, folder) == [0, 1, 2, 3]
    chain(spark.createDataFrame(rows[:10], schema()), 2)  # a batch that Spark repeats after its commit
    want = C.whole(spark.createDataFrame(rows, schema()), *topology, RULE)
    for name, columns in NAMES.items():
        assert plain(S.results(spark, folder, name), columns) == plain(want[name], columns), name
    reports = want["reports"].collect()
    assert {r.status for r in reports} >= {"diagnosed"} and any(r.rank == 2 for r in reports)
    first = [r for r in reports if (r.service, r.win, r.rank) == ("b", 25, 1)]
    assert first and first[0].root_service == "b" and first[0].root_metric == "cpu"
    assert S.results(spark, folder, "late").count() == 0


def test_rows_of_final_windows_are_late_and_change_nothing(spark, topology):
    rows, folder = table(), scratch(spark, "chain")
    chain = S.Chain(folder, *topology, RULE)
    late = [("a", "cpu", 12.0, 1e6), ("b", "cpu", 99.0, 1e6)]
    chain(spark.createDataFrame(rows[:200], schema()), 0)
    chain(spark.createDataFrame([*rows[200:], *late], schema()), 1)
    chain.finish(spark)
    assert {(r.service, r.timestamp, r.win) for r in S.results(spark, folder, "late").collect()} == {("a", 12.0, 1), ("b", 99.0, 9)}
    want = C.whole(spark.createDataFrame(rows, schema()), *topology, RULE)
    assert plain(S.results(spark, folder, "scores"), NAMES["scores"]) == plain(want["scores"], NAMES["scores"])


def test_an_empty_stream_gives_empty_results(spark, topology):
    folder = scratch(spark, "chain")
    chain = S.Chain(folder, *topology, RULE)
    chain(spark.createDataFrame([], schema()), 0)
    chain.finish(spark)
    assert all(S.results(spark, folder, n).count() == 0 for n in NAMES)
    assert all(df.count() == 0 for df in C.whole(spark.createDataFrame([], schema()), *topology, RULE).values())
