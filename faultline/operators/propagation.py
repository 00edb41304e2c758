"""How anomalies spread: parents, ridge fits from distributed sums, recursive fits, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aligned(panel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node of ``nodes`` at every time of the panel, with mask where it has a value. Times and nodes are the two axes of the panel."""
    grid = panel.select("ts").distinct().join(nodes.select("node_id").distinct())
    return grid.join(panel.select("ts", "node_id", "value"), ["ts", "node_id"], "left").withColumn("mask", F.col("value").isNotNull())


def incident_panel(panel: DataFrame, incidents: DataFrame, step: float) -> DataFrame:
    """Rows of each incident and of the unbroken run of times (gaps up to 1.5 steps) right before it."""
    times = panel.select("ts").distinct().join(incidents.select("incident_id", "start_ts", "end_ts"), F.col("ts") < F.col("end_ts"))
    w = Window.partitionBy("incident_id").orderBy(F.desc("ts"))
    gap = F.when(F.coalesce(F.lag("ts").over(w) - F.col("ts"), F.lit(0.0)) > 1.5 * step, 1).otherwise(0)
    run = times.withColumn("g", gap).withColumn("breaks", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("breaks = 0")
    return panel.join(run.select("incident_id", "ts", (F.col("ts") >= F.col("start_ts")).alias("faulty")), "ts")


def allowed_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, parent, relation): self, same service, and nodes of services with an edge into the target's; self first."""
    t = nodes.select(F.col("node_id").alias("target"), F.col("service").alias("ts"))
    p = nodes.select(F.col("node_id").alias("parent"), F.col("service").alias("ps"))
    same = t.join(p, F.col("ts") == F.col("ps")).select("target", "parent", F.when(F.col("target") == F.col("parent"), "self").otherwise("service").alias("relation"))
    far = t.join(edges.select(F.col("src").alias("es"), F.col("dst").alias("ts")), "ts").join(p, F.col("es") == F.col("ps")).where("es <> ts")
    return same.unionByName(far.select("target", "parent", F.lit("graph").alias("relation")).distinct())


def limited_parents(parents: DataFrame, most: int) -> DataFrame:
    """At most ``most`` parents of a target: self, then same service, then graph, by name."""
    order = F.when(F.col("relation") == "self", 0).when(F.col("relation") == "service", 1).otherwise(2)
    w = Window.partitionBy("target").orderBy(order, "parent")
    return parents.withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= most)


def lagged(panel: DataFrame, parents: DataFrame, lags: list[int], step: float) -> DataFrame:
    """Training rows in long form: (target, ts, y, feature, x), the feature being a parent at a lag."""
    y = panel.select(F.col("node_id").alias("target"), "ts", F.col("z").alias("y"))
    x = panel.select(F.col("node_id").alias("parent"), F.col("ts").alias("xt"), F.col("z").alias("x"))
    shifted = x.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("ts", F.col("xt") + F.col("lag") * step)
    named = shifted.select("parent", "ts", "x", "lag", F.concat_ws("@", "parent", F.col("lag").cast("string")).alias("feature"))
    return y.join(parents.select("target", "parent"), "target").join(named, ["parent", "ts"]).select("target", "ts", "y", "feature", "x")


def complete(rows: DataFrame) -> DataFrame:
    """Training rows of the times at which a target has all of its features."""
    need = rows.groupBy("target").agg(F.count_distinct("feature").alias("need"))
    have = rows.groupBy("target", "ts").agg(F.count("*").alias("have"))
    return rows.join(have.join(need, "target").where("have = need").select("target", "ts"), ["target", "ts"])


def gram(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Per target the entries sum(w xi xj) and sum(w xi y) of the normal equations, as one row of arrays in feature order.

    Products are made within one (target, time) row of at most the parent limit, then summed in Spark.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    wide = rows.withColumn("w", w).groupBy("target", "ts", "y", "w").agg(F.sort_array(F.collect_list(F.struct("feature", "x"))).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a: F.transform("f", lambda b: F.struct(a["feature"].alias("i"), b["feature"].alias("j"), (a["x"] * b["x"] * F.col("w")).alias("v")))))
    right = F.transform("f", lambda a: F.struct(a["feature"].alias("i"), F.lit("").alias("j"), (a["x"] * F.col("y") * F.col("w")).alias("v")))
    flat = wide.select("target", F.explode(F.concat(pairs, right)).alias("e")).select("target", "e.*")
    cells = flat.groupBy("target", "i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return cells.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("i", "j", "v"))).alias("cells"), F.max("n").alias("rows"))


def ridge(grams: DataFrame, lam: float = 1.0) -> DataFrame:
    """(target, feature, coefficient, rows, rank, condition): solves the small system of each target."""

    def solve(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for _, row in frame.iterrows():
                names = sorted({c["i"] for c in row["cells"]})
                at = {n: k for k, n in enumerate(names)}
                g, b = np.zeros((len(names), len(names))), np.zeros(len(names))
                for c in row["cells"]:
                    if c["j"]:
                        g[at[c["i"]], at[c["j"]]] = c["v"]
                    else:
                        b[at[c["i"]]] = c["v"]
                beta = np.linalg.solve(g + lam * np.eye(len(names)), b)
                yield pd.DataFrame({"target": row["target"], "feature": names, "coefficient": beta, "rows": row["rows"], "rank": int(np.linalg.matrix_rank(g)), "condition": float(np.linalg.cond(g + lam * np.eye(len(names))))})

    return grams.mapInPandas(solve, "target string, feature string, coefficient double, rows long, rank int, condition double")


def predict(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(target, ts, y, predicted, residual, contributions)."""
    j = rows.join(coefficients.select("target", "feature", "coefficient"), ["target", "feature"])
    part = F.col("coefficient") * F.col("x")
    t = j.groupBy("target", "ts", "y").agg(F.sum(part).alias("predicted"), F.sort_array(F.collect_list(F.struct("feature", part.alias("part")))).alias("contributions"))
    return t.withColumn("residual", F.col("y") - F.col("predicted"))


def recursive(rows: DataFrame, forgetting: float = 0.98, start: float = 100.0) -> DataFrame:
    """(target, ts, predicted, residual, updates): recursive least squares per target in time order, prediction before each update."""
    wide = rows.groupBy("target", "ts", "y").agg(F.sort_array(F.collect_list(F.struct("feature", "x"))).alias("f"))

    def scan(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("ts")
        names = sorted({x["feature"] for f in pdf["f"] for x in f})
        at = {n: k for k, n in enumerate(names)}
        theta, p, out, n = np.zeros(len(names)), np.eye(len(names)) * start, [], 0
        for ts, y, f in zip(pdf["ts"], pdf["y"], pdf["f"]):
            x = np.zeros(len(names))
            for c in f:
                x[at[c["feature"]]] = c["x"]
            guess = float(theta @ x)
            out.append((key[0], ts, guess, y - guess, n))
            gain = p @ x / (forgetting + x @ p @ x)
            theta = theta + gain * (y - guess)
            p = (p - np.outer(gain, x @ p)) / forgetting
            n += 1
        return pd.DataFrame(out, columns=["target", "ts", "predicted", "residual", "updates"])

    return wide.groupBy("target").applyInPandas(scan, "target string, ts double, predicted double, residual double, updates long")


def support_index(coefficients: DataFrame, service_of) -> DataFrame:
    """(src, dst, support): largest absolute coefficient between services, both directions."""
    a = coefficients.select(service_of(F.col("parent")).alias("src"), service_of(F.col("target")).alias("dst"), F.abs("coefficient").alias("c")).where("src <> dst")
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c")).groupBy("src", "dst").agg(F.max("c").alias("support"))
