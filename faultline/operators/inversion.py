"""Sparse attribution of unexplained anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.scalars import group_shrink, intervention_weight, ipw_weight, soft_threshold


def phases(residuals: DataFrame) -> DataFrame:
    return residuals.withColumn("phase", F.when(F.col("timestamp") < F.col("start_ts"), "baseline").otherwise("faulty"))


def sparse_scores(residuals: DataFrame, l1: float = 0.5, group: float = 0.1, clip: float = 100.0) -> DataFrame:
    """Residual lift, soft threshold, metric weight, group shrinkage per service, rank per incident."""
    on = lambda p: F.avg(F.when(F.col("phase") == p, F.abs("residual")))
    t = phases(residuals).groupBy("incident_id", "service", "metric").agg(F.coalesce(on("baseline"), F.lit(0.0)).alias("baseline_abs"), F.coalesce(on("faulty"), F.lit(0.0)).alias("faulty_abs"))
    t = t.withColumn("residual_lift", F.greatest(F.lit(0.0), F.col("faulty_abs") - F.col("baseline_abs")))
    raw = F.greatest(soft_threshold(F.col("residual_lift"), l1), F.lit(0.0)) * intervention_weight(F.col("metric"))
    t = t.withColumn("raw", raw).withColumn("intervention_score", F.least(F.lit(clip), group_shrink(F.col("raw"), Window.partitionBy("incident_id", "service"), group)))
    return t.drop("raw").withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("intervention_score"), "service", "metric")))


def ipw_sparse_scores(residuals: DataFrame, l1: float = 0.5, penalty: float = 0.75, full: int = 3) -> DataFrame:
    """Inverse-propensity weighted residual lift with a penalty for few observations, confidence and rank."""
    w = ipw_weight(F.col("probability"))
    mean = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, w * F.abs("residual"))) / F.sum(F.when(F.col("phase") == p, w)), F.lit(0.0))
    n = lambda p: F.count(F.when(F.col("phase") == p, 1))
    t = phases(residuals).groupBy("incident_id", "service", "metric").agg(mean("baseline").alias("baseline_abs"), mean("faulty").alias("faulty_abs"), n("baseline").alias("n_baseline"), n("faulty").alias("n_faulty"))
    t = t.withColumn("residual_lift", F.greatest(F.lit(0.0), F.col("faulty_abs") - F.col("baseline_abs")))
    few = (F.col("n_baseline") < 2) | (F.col("n_faulty") < 2)
    t = t.withColumn("intervention_score", F.greatest(F.col("residual_lift") - l1, F.lit(0.0)) * F.when(few, penalty).otherwise(1.0))
    t = t.withColumn("confidence", F.least(F.lit(1.0), F.least("n_baseline", "n_faulty") / full))
    order = Window.partitionBy("incident_id").orderBy(F.desc("intervention_score"), F.desc("residual_lift"), F.desc("confidence"), "service", "metric")
    return t.withColumn("rank", F.row_number().over(order))


def residual_signal(calibrated: DataFrame, share: float = 0.2, load_penalty: float = 0.6, clip: float = 10.0) -> DataFrame:
    """Mean of the largest share of positive residuals of each node, damped for load metrics, clipped."""
    ups = F.sort_array(F.collect_list(F.when(F.col("calibrated") > 0, F.col("calibrated"))), asc=False)
    t = calibrated.groupBy("incident_id", "service", "metric", "family").agg(ups.alias("u"))
    k = F.greatest(F.lit(1), F.ceil(F.size("u") * share)).cast("int")
    mean = F.when(F.size("u") == 0, 0.0).otherwise(F.aggregate(F.slice("u", 1, k), F.lit(0.0), lambda a, x: a + x) / k)
    return t.withColumn("signal", F.least(F.lit(clip), mean * F.when(F.col("family") == "load", load_penalty).otherwise(1.0))).drop("u")


def metric_edges(nodes: DataFrame, service_edges: DataFrame, same_service: float = 1.0, same_family: float = 0.5) -> DataFrame:
    """Edges between the nodes of a service, and of the same family across linked services (a before b)."""
    a, b = (nodes.select("incident_id", F.col("node_id").alias(x), F.col("service").alias(f"s{x}"), F.col("family").alias(f"f{x}")) for x in "ab")
    inside = a.join(b, (a["incident_id"] == b["incident_id"]) & (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))).select(a["incident_id"], "a", "b", F.lit(same_service).alias("weight"))
    e = service_edges.select(F.col("src").alias("sa"), F.col("dst").alias("sb"))
    across = a.join(e, "sa").join(b, ["incident_id", "sb"]).where("fa = fb and sa <> sb").select("incident_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(same_family).alias("weight"))
    return inside.unionByName(across).groupBy("incident_id", "a", "b").agg(F.max("weight").alias("weight"))


def penalties(signal: DataFrame) -> DataFrame:
    """L1 and group penalties per incident from quantiles of the signal, within fixed bounds."""
    t = signal.groupBy("incident_id").agg(F.percentile(F.abs("signal"), 0.6).alias("q"))
    g = signal.groupBy("incident_id", "service").agg(F.sqrt(F.sum(F.col("signal") * F.col("signal"))).alias("norm")).groupBy("incident_id").agg(F.percentile("norm", 0.5).alias("gq"))
    bound = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return t.join(g, "incident_id").select("incident_id", bound(F.col("q"), 0.15, 3.0).alias("l1"), bound(F.col("gq") * 0.2, 0.05, 1.5).alias("group"))


def graph_inversion(signal: DataFrame, edges: DataFrame, pen: DataFrame, tv: float = 0.08, rounds: int = 300) -> DataFrame:
    """(incident_id, node_id, x): minimiser of 1/2|r - x|^2 + l1|x| + tv sum w|xi - xj| + group sum |x_g|, one incident a task.

    Built in Spark, solved per incident by the alternating direction method; an incident has one row per node.
    """
    e = edges.groupBy("incident_id").agg(F.collect_list(F.struct("a", "b", "weight")).alias("edges"))
    n = signal.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "service", "signal"))).alias("nodes"))
    rows = n.join(e, "incident_id", "left").join(pen, "incident_id")

    def solve(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for _, row in frame.iterrows():
                names = [x["node_id"] for x in row["nodes"]]
                r = np.array([x["signal"] for x in row["nodes"]])
                at = {k: i for i, k in enumerate(names)}
                links = [] if row["edges"] is None else [x for x in row["edges"] if x["a"] in at and x["b"] in at]
                d = np.zeros((len(links), len(r)))
                for i, x in enumerate(links):
                    d[i, at[x["a"]]], d[i, at[x["b"]]] = x["weight"], -x["weight"]
                services = [x["service"] for x in row["nodes"]]
                groups = [np.flatnonzero([s == g for s in services]) for g in sorted(set(services))]
                x, *_ = admm(r, d, groups, row["l1"], tv, row["group"], rounds)
                yield pd.DataFrame({"incident_id": row["incident_id"], "node_id": names, "x": x})

    return rows.mapInPandas(solve, "incident_id string, node_id string, x double")


def admm(r, d, groups, l1: float, tv: float, group: float, rounds: int, rho: float = 1.0, tolerance: float = 1e-7):
    """The alternating direction method for the graph objective: splits for |x|, |Dx| and the groups."""
    import numpy as np

    shrink = lambda v, t: np.sign(v) * np.maximum(np.abs(v) - t, 0)
    n = len(r)
    inverse = np.linalg.inv(np.eye(n) * (1 + 2 * rho) + rho * d.T @ d)
    z, y, u = np.zeros(n), np.zeros(len(d)), np.zeros(n)
    zu, yu, uu = np.zeros(n), np.zeros(len(d)), np.zeros(n)
    x = r.copy()
    for k in range(rounds):
        before = x
        x = inverse @ (r + rho * ((z - zu) + d.T @ (y - yu) + (u - uu)))
        z = shrink(x + zu, l1 / rho)
        y = shrink(d @ x + yu, tv / rho)
        u = x + uu
        for g in groups:
            norm = np.linalg.norm(u[g])
            u[g] *= max(0.0, 1 - group / rho / norm) if norm > 0 else 0.0
        zu, yu, uu = zu + x - z, yu + d @ x - y, uu + x - u
        if np.abs(x - before).max(initial=0) < tolerance and np.abs(x - z).max(initial=0) < 1e-5:
            break
    return np.where(np.abs(z) > 0, x, 0.0), k + 1


def objective(signal: DataFrame, solution: DataFrame, edges: DataFrame, pen: DataFrame, tv: float = 0.08) -> DataFrame:
    """The parts of the objective of each incident."""
    j = signal.join(solution, ["incident_id", "node_id"])
    a = j.groupBy("incident_id").agg((F.sum((F.col("signal") - F.col("x")) ** 2) / 2).alias("data"), F.sum(F.abs("x")).alias("abs"))
    x = solution.select("incident_id", F.col("node_id").alias("a"), F.col("x").alias("xa")), solution.select("incident_id", F.col("node_id").alias("b"), F.col("x").alias("xb"))
    t = edges.join(x[0], ["incident_id", "a"]).join(x[1], ["incident_id", "b"]).groupBy("incident_id").agg(F.sum(F.col("weight") * F.abs(F.col("xa") - F.col("xb"))).alias("tv"))
    g = j.groupBy("incident_id", "service").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).groupBy("incident_id").agg(F.sum("norm").alias("norms"))
    r = a.join(t, "incident_id", "left").join(g, "incident_id").join(pen, "incident_id")
    return r.select("incident_id", "data", (F.col("l1") * F.col("abs")).alias("l1_part"), (tv * F.coalesce("tv", F.lit(0.0))).alias("tv_part"), (F.col("group") * F.col("norms")).alias("group_part"))


def post_sparsify(solution: DataFrame, share: float = 0.35, per_service: int = 2) -> DataFrame:
    """At most ``per_service`` nodes of a service, and of these the top share of the incident's nodes."""
    w = Window.partitionBy("incident_id")
    t = solution.withColumn("total", F.count("*").over(w)).where("x > 0")
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("incident_id", "service").orderBy(F.desc("x"), "node_id"))).where(F.col("k") <= per_service)
    t = t.withColumn("rank", F.row_number().over(w.orderBy(F.desc("x"), "node_id")))
    return t.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("total") * share))).drop("k", "total")


def group_solve(rows: DataFrame, keys: list[str], l1: float = 0.15, group: float = 0.25, eta: float = 2.0, rounds: int = 200, step: float = 0.5) -> DataFrame:
    """Non-negative sparse-group solve, one row per group with arrays r (residuals) and q (weights) and a burst strength h.

    Proximal gradient steps as a fold over array columns: any number of groups, no Python.
    """
    lam = F.lit(group) / (1 + eta * F.col("h"))
    start = F.transform("r", lambda _: F.lit(0.0))

    def prox(theta, _):
        moved = F.transform(F.arrays_zip(theta.alias("t"), F.col("r").alias("r"), F.col("q").alias("q")), lambda z: F.greatest(z["t"] - step * z["q"] * (z["t"] - z["r"]) - step * l1, F.lit(0.0)))
        norm = F.sqrt(F.aggregate(moved, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(moved, lambda x: F.when(norm > 0, x * F.greatest(F.lit(0.0), 1 - step * lam / norm)).otherwise(0.0))

    return rows.withColumn("theta", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, prox))


def fista(frames, rounds: int = 500):
    """Weighted three-block sparse-group solve of one incident a row: columns a (row-major matrix), r, w, l1, blocks, group."""
    import numpy as np
    import pandas as pd

    for frame in frames:
        for _, row in frame.iterrows():
            r, w = np.asarray(row["r"]), np.asarray(row["w"])
            a = np.asarray(row["a"]).reshape(len(r), -1)
            l1, blocks = np.asarray(row["l1"]), np.asarray(row["blocks"])
            lip = np.linalg.norm((a.T * w) @ a, 2) + 1e-12
            x = y = np.zeros(a.shape[1])
            t = 1.0
            for k in range(rounds):
                grad = a.T @ (w * (a @ y - r))
                z = y - grad / lip
                z = np.sign(z) * np.maximum(np.abs(z) - l1 / lip, 0)
                for b in np.unique(blocks):
                    norm = np.linalg.norm(z[blocks == b])
                    z[blocks == b] *= max(0.0, 1 - row["group"] / lip / norm) if norm > 0 else 0.0
                t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
                y = z + (t - 1) / t2 * (z - x)
                done = np.abs(z - x).max(initial=0) < 1e-9
                x, t = z, t2
                if done:
                    break
            value = 0.5 * (w * (a @ x - r) ** 2).sum() + (l1 * np.abs(x)).sum() + row["group"] * sum(np.linalg.norm(x[blocks == b]) for b in np.unique(blocks))
            yield pd.DataFrame({"incident_id": [row["incident_id"]], "x": [x.tolist()], "objective": [float(value)], "iterations": [k + 1], "converged": [bool(done)]})
