"""Root candidates from residuals: the exact solution of a non-negative sparse-group problem, one expression a group.

Of each alert: minimise sum(q/2 (r - x)^2 + l1 x) over its metrics plus sum(p_g |x_g|) over its groups, with x >= 0. The design is the
identity, so each group stands alone: with c = max(q r - l1, 0) it is x = c t / (q t + p), where t = |x| solves
sum((c / (q t + p))^2) = 1, and zero if |c| <= p. That sum falls in t, so halving an interval finds t to the last bits; nothing is
iterated over the data and no group leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALVINGS = 60


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def group_norm(c: Column, q: Column, penalty: Column) -> Column:
    """t of the docstring above, for arrays c and q of a group."""
    both = F.arrays_zip(c.alias("c"), q.alias("q"))
    excess = lambda t: _total(F.transform(both, lambda e: F.pow(e["c"] / (e["q"] * t + penalty), 2))) > 1
    top = F.sqrt(_total(F.transform(both, lambda e: F.pow(e["c"] / e["q"], 2))))
    start = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        over = excess(mid)
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    t = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)
    return F.when(F.sqrt(_total(F.transform(c, lambda x: x * x))) <= penalty, 0.0).otherwise((t["lo"] + t["hi"]) / 2)


def ranked_roots(rows: DataFrame, alert: list[str], penalties: DataFrame, evidence: DataFrame, l1: float, eta: float, keep: int) -> DataFrame:
    """The ``keep`` best groups (entity, category) of each alert with all that they rest on, one row for each metric.

    rows: alert columns, entity, category, metric, residual, quality (above 0); penalties: (category, base); evidence: alert columns,
    entity, strength (0 to 1), which lowers the group's penalty to base / (1 + eta strength). Columns: rank, score (the group's norm), and
    for each metric contribution, residual, quality; base, effective, strength.
    """
    keys = [*alert, "entity", "category"]
    c = F.greatest(F.col("quality") * F.col("residual") - l1, F.lit(0.0))
    groups = rows.withColumn("c", c).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("metric", "c", "residual", "quality"))).alias("m"))
    with_evidence = groups.join(evidence, [*alert, "entity"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0))).join(F.broadcast(penalties), "category")
    priced = with_evidence.withColumn("effective", F.col("base") / (1 + eta * F.col("strength")))
    solved = priced.withColumn("score", group_norm(F.transform("m", lambda x: x["c"]), F.transform("m", lambda x: x["quality"]), F.col("effective")))
    w = Window.partitionBy(*alert).orderBy(F.desc(F.round("score", 9)), "entity", "category")
    best = solved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    x = best.select(*keys, "rank", "score", "base", "effective", "strength", F.explode("m").alias("x"))
    part = F.when(F.col("score") > 0, F.col("x.c") * F.col("score") / (F.col("x.quality") * F.col("score") + F.col("effective"))).otherwise(0.0)
    return x.select(*keys, "rank", "score", "base", "effective", "strength", "x.metric", part.alias("contribution"), "x.residual", "x.quality")
