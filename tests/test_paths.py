"""Best propagation paths against an enumeration of all of them."""

import math
import random

import pytest

from faultline.operators import paths as P


def brute(roots, edges, targets, most, keep, penalty):
    out = []
    for inc, root, support in roots:
        found = []

        def visit(node, path, lags, score):
            if (inc, node) in targets:
                found.append((-score, ">".join(path), lags))
            if len(lags) < most:
                for parent, target, lag, _, s in edges:
                    if parent == node and target not in path:
                        visit(target, [*path, target], [*lags, lag], score * s * math.exp(-penalty))

        if support > 0:
            visit(root, [root], [], min(support, 1.0))
        found.sort(key=lambda x: (x[0], x[1], "[" + ",".join(map(str, x[2])) + "]"))
        out += [(inc, root, path, lags, round(-score, 12), k) for k, (score, path, lags) in enumerate(found[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,keep,most", [(1, 3, 4), (2, 1, 3), (3, 5, 1)])
def test_best_paths_equal_an_enumeration(spark, seed, keep, most):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    coefficients = [(a, b, lag, rng.choice([rng.uniform(-0.3, 1), 0.5]), rng.random() < 0.9) for a in names for b in names if a != b for lag in (1, 2) if rng.random() < 0.3]
    supports = P.supports(spark.createDataFrame(coefficients, "parent string, target string, lag int, coefficient double, ready boolean"), 0.1)
    edges = [tuple(r) for r in supports.collect()]
    top = max(c for *_, c, ready in coefficients if ready)
    assert sorted(edges) == sorted((a, b, lag, c, c / top) for a, b, lag, c, ready in coefficients if ready and c > 0 and c / top >= 0.1)
    roots = [("i1", "n0", 0.7), ("i1", "n1", 3.0), ("i2", "n0", 0.2), ("i2", "n5", 0.0), ("i3", "n2", 0.5)]
    targets = {("i1", "n7"), ("i1", "n1"), ("i2", "n8")}
    got = P.best_paths(spark.createDataFrame(roots, "incident_id string, root string, support double"), supports, spark.createDataFrame(sorted(targets), "incident_id string, node string"), most, keep, 0.1).collect()
    assert sorted((r.incident_id, r.root, ">".join(r.path), [s.lag for s in r.steps], round(r.score, 12), r.rank) for r in got) == brute(roots, edges, targets, most, keep, 0.1)
    for r in got:
        assert r.hops == len(r.steps)


def test_a_dense_graph_is_pruned(spark):
    """Of 40 nodes all joined with each other there are over two million paths of up to four edges from a root."""
    rng = random.Random(6)
    edges = [(f"n{i}", f"n{j}", 1, 0.0, rng.uniform(0.05, 0.3) if j != 39 else 0.9) for i in range(40) for j in range(40) if i != j]
    got = P.best_paths(
        spark.createDataFrame([("i", "n0", 1.0)], "incident_id string, root string, support double"), spark.createDataFrame(edges, "parent string, target string, lag int, coefficient double, support double"),
        spark.createDataFrame([("i", "n39")], "incident_id string, node string"), 4, 3, 0.2,
    ).collect()
    assert [r.rank for r in got] == [1, 2, 3] and got[0].path == ["n0", "n39"] and got[1].hops == 2


def test_no_edges_no_roots(spark):
    none = spark.createDataFrame([], "parent string, target string, lag int, coefficient double, support double")
    roots = spark.createDataFrame([("i", "a", 0.5), ("i", "b", 0.5)], "incident_id string, root string, support double")
    targets = spark.createDataFrame([("i", "a")], "incident_id string, node string")
    assert [(r.root, r.path, r.hops, r.score) for r in P.best_paths(roots, none, targets, 3, 2, 0.1).collect()] == [("a", ["a"], 0, 0.5)]
    assert P.best_paths(roots.limit(0), none, targets, 3, 2, 0.1).count() == 0
