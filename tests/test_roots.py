"""Ranked roots against a general solver of the same problem."""

import random

import numpy as np

from faultline.operators import roots as R


def descend(r, q, l1, penalty):
    """Proximal gradient steps on one group until they stand still."""
    x, step = np.zeros(len(r)), 1 / q.max()
    for _ in range(20_000):
        z = np.maximum(x - step * (q * (x - r) + l1), 0)
        norm = np.linalg.norm(z)
        new = z * max(0.0, 1 - step * penalty / norm) if norm else z
        if np.abs(new - x).max() < 1e-14:
            break
        x = new
    return x


def test_contributions_equal_a_general_solver(spark):
    rng = random.Random(4)
    rows = [(i, e, c, f"{c}.{k}", rng.uniform(-1, 4), rng.choice([0.2, 0.5, 1.0, rng.random() + 0.01])) for i in range(6) for e in "ab" for c in ("x", "y") for k in range(rng.randint(1, 4))]
    base, strength = {"x": 0.8, "y": 1.5}, {(i, "a"): rng.random() for i in range(5)}
    got = R.ranked_roots(
        spark.createDataFrame(rows, "alert int, entity string, category string, metric string, residual double, quality double"), ["alert"], spark.createDataFrame(list(base.items()), "category string, base double"),
        spark.createDataFrame([(i, e, s) for (i, e), s in strength.items()], "alert int, entity string, strength double"), 0.1, 2.0, 3,
    ).collect()
    want = {}
    for i in range(6):
        scored = []
        for e in "ab":
            for c in "xy":
                group = sorted((m, r, q) for a, e2, c2, m, r, q in rows if (a, e2, c2) == (i, e, c))
                p = base[c] / (1 + 2 * strength.get((i, e), 0.0))
                x = descend(np.array([g[1] for g in group]), np.array([g[2] for g in group]), 0.1, p)
                scored.append((-round(float(np.linalg.norm(x)), 9), e, c, dict(zip([g[0] for g in group], x)), p))
        for rank, (score, e, c, parts, p) in enumerate(sorted(scored, key=lambda s: s[:3])[:3], 1):
            want.update({(i, e, c, m): (rank, -score, v, p) for m, v in parts.items()})
    assert {(r.alert, r.entity, r.category, r.metric) for r in got} == want.keys() and any(r.score > 0 for r in got) and any(r.score == 0 for r in got)
    for r in got:
        rank, score, part, penalty = want[r.alert, r.entity, r.category, r.metric]
        assert r.rank == rank and abs(r.score - score) < 1e-7 and abs(r.contribution - part) < 1e-7 and abs(r.effective - penalty) < 1e-12
    norms = {}
    for r in got:
        norms.setdefault((r.alert, r.entity, r.category, r.score), []).append(r.contribution)
    assert all(abs(k[3] - np.linalg.norm(v)) < 1e-9 for k, v in norms.items())
