"""The report of an alert: the chosen root with its gates, the chain of evidence, and all of it as one nested row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Gates:
    """Least values of a root: its share of what is explained, margin to the next, identifiability and confidence; and of a strong one."""

    relative: float = 0.2
    margin: float = 0.1
    identifiable: float = 0.1
    weak: float = 0.4
    strong: float = 0.6
    strong_identifiable: float = 0.3


def gated(candidates: DataFrame, alert: list[str], gates: Gates) -> DataFrame:
    """Candidates (root_service, gain, relative, margin, identifiability, confidence) with their rank by share, and the reasons against each."""
    tests = [
        (F.col("relative") < gates.relative, "low_counterfactual"), (F.col("margin") < gates.margin, "low_margin"), (F.col("identifiability") < gates.identifiable, "low_identifiability"),
        (F.col("confidence") < gates.weak, "low_confidence"), (F.col("gain") <= 0, "zero_candidate_signature"),
    ]
    w = Window.partitionBy(*alert).orderBy(F.desc(F.round("relative", 9)), "root_service")
    return candidates.withColumns({"rank": F.row_number().over(w), "against": F.array_compact(F.array(*[F.when(test, reason) for test, reason in tests]))})


def primary(ranked: DataFrame, alert: list[str], gates: Gates) -> DataFrame:
    """One row for each alert: the first candidate without reasons against it (strong or weak), or none and the reasons against the first."""
    free = F.size("against") == 0
    strong = (F.col("confidence") >= gates.strong) & (F.col("identifiability") >= gates.strong_identifiable)
    best = F.min_by(F.struct("root_service", strong.alias("strong"), "confidence"), F.when(free, F.col("rank")))
    rows = ranked.groupBy(*alert).agg(best.alias("b"), F.min_by("against", "rank").alias("why"), F.count("*").alias("candidates"))
    status = F.when(F.col("b").isNull(), "ambiguous").when(F.col("b.strong"), "strong").otherwise("weak")
    return rows.select(*alert, status.alias("status"), F.col("b.root_service").alias("primary_root"), F.col("b.confidence").alias("confidence"), F.when(F.col("b").isNull(), F.col("why")).otherwise(F.array().cast("array<string>")).alias("reasons"), "candidates")


def evidence_chain(ranked: DataFrame, groups: DataFrame, evidence: DataFrame, paths: DataFrame, alert: list[str]) -> DataFrame:
    """(alert, candidate, kind, source, strength): what speaks for each candidate, one row a piece.

    source_anomaly and solver_contribution from groups (entity, metric, residual, contribution above 0), counterfactual from ranked
    (relative), normalized_evidence and excluded_evidence from evidence (entity, source, strength, used), propagation_path from paths (entity, source, score).
    """
    piece = lambda df, who, kind, source, strength: df.select(*alert, F.col(who).alias("candidate"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), source.cast("string").alias("source"), strength.cast("double").alias("strength"))
    used = groups.where("contribution > 0")
    return (
        piece(used, "entity", "source_anomaly", F.col("metric"), F.col("residual"))
        .unionByName(piece(used, "entity", "solver_contribution", F.col("metric"), F.col("contribution")))
        .unionByName(piece(ranked, "root_service", "counterfactual", F.col("root_service"), F.col("relative")))
        .unionByName(piece(evidence, "entity", F.when(F.col("used"), "normalized_evidence").otherwise("excluded_evidence"), F.col("source"), F.when(F.col("used"), F.col("strength")).otherwise(0.0)))
        .unionByName(piece(paths, "entity", "propagation_path", F.col("source"), F.col("score")))
    )


def nested(choice: DataFrame, ranked: DataFrame, chain: DataFrame, paths: DataFrame, alert: list[str]) -> DataFrame:
    """One row for each alert: its choice with arrays of candidates (by rank), evidence (by candidate, kind, source) and paths (by rank), and a fingerprint of it all.

    An alert's candidates, evidence and paths are bounded by the services within a few hops.
    """
    listed = lambda df, name, *cols: df.groupBy(*alert).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = choice
    for part in (
        listed(ranked, "ranked_candidates", "rank", "root_service", "relative", "margin", "identifiability", "confidence", "against"),
        listed(chain, "evidence_chain", "candidate", "kind", "source", "strength"), listed(paths, "paths", "rank", "root", "path", "score"),
    ):
        out = out.join(part, alert, "left")
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*out.columns)), 256))


def result_rows(groups: DataFrame, paths: DataFrame, alert: list[str], keep: int = 5) -> DataFrame:
    """One row for each alert: top metrics (entity.metric, by contribution), top services with their best metric, root type, path.

    The root type is the category with most contribution; the path the best one of any root, else the best service alone.
    """
    used = groups.where("contribution > 0")
    ordered = lambda *cols: [*[F.desc(F.round(c, 9)) if c == "x" else F.col(c) for c in cols]]
    first = lambda df, name, what, *cols: df.withColumn("_r", F.row_number().over(Window.partitionBy(*alert).orderBy(*ordered(*cols)))).where(F.col("_r") <= keep).groupBy(*alert).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", what.alias("w")))), lambda s: s["w"]).alias(name))
    metrics = first(used.withColumn("x", F.col("contribution")).withColumn("n", F.concat_ws(".", "entity", "metric")), "top_metrics", F.col("n"), "x", "n")
    services = used.groupBy(*alert, "entity").agg(F.max("contribution").alias("x"), F.max_by("metric", F.struct(F.round("contribution", 9), "metric")).alias("best_metric"))
    top_services = first(services, "top_services", F.concat_ws("/", "entity", "best_metric"), "x", "entity")
    kinds = first(used.groupBy(*alert, "category").agg(F.sum("contribution").alias("x")), "types", F.col("category"), "x", "category")
    best_path = paths.groupBy(*alert).agg(F.min_by("path", F.struct((-F.round("score", 9)).alias("s"), F.size("path").alias("n"), F.concat_ws(">", "path").alias("p"))).alias("path"))
    out = metrics.join(top_services, alert).join(kinds, alert).join(best_path, alert, "left")
    alone = F.array(F.substring_index(F.col("top_services")[0], "/", 1))
    return out.select(*alert, "top_metrics", "top_services", F.col("types")[0].alias("root_type"), F.coalesce("path", alone).alias("path"))
