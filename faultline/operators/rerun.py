"""Blind reruns: evidence made without any label, and both scoring stages again, for all incidents of all runs in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import evidence_type, root_type
from faultline.operators import evidence as E
from faultline.operators import inversion as I


def near(metrics: DataFrame, windows: DataFrame, before: float, cell: float) -> DataFrame:
    """metrics with each window (incident_id, start_ts, end_ts) that they lie in or up to ``before`` seconds ahead of, found by time cells: no join on a range alone."""
    cells = F.explode(F.sequence(F.floor((F.col("start_ts") - before) / cell), F.floor(F.col("end_ts") / cell))).alias("_cell")
    w = windows.select("incident_id", "start_ts", "end_ts", cells)
    inside = (F.col("timestamp") >= F.col("start_ts") - before) & (F.col("timestamp") <= F.col("end_ts"))
    return metrics.withColumn("_cell", F.floor(F.col("timestamp") / cell)).join(w, "_cell").where(inside).drop("_cell")


def blind_evidence(rows: DataFrame, least: float, keep: int) -> DataFrame:
    """(incident_id, service, metric, value): the ``keep`` largest lifts of each type within a window against the time ahead of it, as shares of the type's largest."""
    side = lambda test: F.avg(F.when(test, F.col("value")))
    lift = rows.groupBy("incident_id", "service", "metric").agg(side(F.col("timestamp") < F.col("start_ts")).alias("b"), side(F.col("timestamp") >= F.col("start_ts")).alias("a")).where("a is not null and b is not null")
    typed = lift.select("incident_id", "service", "metric", (F.col("a") - F.col("b")).alias("absolute_lift"), root_type(evidence_type(F.col("metric"))).alias("evidence_type"))
    top = E.top_per_type(E.normalised_evidence(typed, "incident_id"), "incident_id", least, keep)
    return top.select("incident_id", "service", "metric", F.col("evidence_score").alias("value"))


def rerun(metrics: DataFrame, windows: DataFrame, before: float, cell: float, least: float = 0.3, keep: int = 3) -> DataFrame:
    """(run_id, incident_id, service, metric, intervention_score, evidence_score, semantic_score, semantic_rank) for windows (run_id, incident_id, start_ts, end_ts).

    metrics: (service, metric, timestamp, value, residual, probability). An incident_id belongs to one run. Whatever evidence the
    runs had is not read: it is replaced by blind evidence before the second stage.
    """
    rows = near(metrics, windows, before, cell)
    scores = I.ipw_sparse_scores(rows, l1=0.05)
    both = E.semantic_scores(scores, blind_evidence(rows, least, keep))
    return both.join(windows.select("run_id", "incident_id"), "incident_id").select("run_id", "incident_id", "service", "metric", "intervention_score", "evidence_score", "semantic_score", "semantic_rank")
