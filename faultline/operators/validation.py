"""Data-quality checks: each rule is a reason, rows carry the reasons that apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows plus reasons: names of the rules that are broken (null counts as broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.withColumn("reasons", broken)


def contract(rows: DataFrame, declared: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """rows whose fields differ from the declared row of their key, or that have none. The declared table is a small dimension."""
    d = declared.select(*on, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    j = rows.join(F.broadcast(d), on, "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return j.withColumn("problem", F.when(F.col("_known").isNull(), "undeclared").when(F.size(wrong) > 0, F.concat(F.lit("differs:"), F.array_join(wrong, ",")))).drop("_known", *[f"_{f}" for f in fields])


def complete_sets(rows: DataFrame, keys: list[str], item: str, expected: DataFrame) -> DataFrame:
    """Missing and extra items per key against the expected list (one small column)."""
    want = expected.agg(F.sort_array(F.collect_set(item)).alias("want"))
    have = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("have"))
    return have.join(want).select(*keys, F.sort_array(F.array_except("want", "have")).alias("missing"), F.sort_array(F.array_except("have", "want")).alias("extra"))


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are expected but not observed (missing) or observed but not expected (extra)."""
    a, b = expected.select(*keys).distinct().withColumn("_e", F.lit(True)), observed.select(*keys).distinct().withColumn("_o", F.lit(True))
    j = a.join(b, keys, "full_outer")
    return j.withColumn("problem", F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "extra")).where("problem is not null").drop("_e", "_o")


def sequence_rules(windows: DataFrame, stream: str, order: str, start: str, end: str, length: float) -> DataFrame:
    """Windows with the archive rules that they break: sequence steps of one, declared length, no overlap."""
    w = Window.partitionBy(stream).orderBy(order)
    first = F.lag(order).over(w).isNull()
    rules = {"sequence": first | (F.col(order) - F.lag(order).over(w) == 1), "length": F.col(end) - F.col(start) <= length, "overlap": first | (F.lag(end).over(w) <= F.col(start))}
    return with_reasons(windows, rules)


def leaks(payload: Column, forbidden: tuple[str, ...]) -> Column:
    """Does a JSON payload hold a forbidden key at any depth (case, underscores and dashes ignored)."""
    keys = F.transform(F.regexp_extract_all(payload, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1)), lambda k: F.lower(F.translate(k, "_-", "")))
    return F.arrays_overlap(keys, F.array(*[F.lit(x.lower().replace("_", "").replace("-", "")) for x in forbidden]))


def ownership(rows: DataFrame, node: str, service: str, metric: str) -> DataFrame:
    """valid, issue and the repaired service and metric of a row; the node id wins over the columns."""
    parts = F.split(F.col(node), r"\.", 2)
    a, b = parts[0], F.get(parts, F.lit(1))
    issue = F.when(b.isNull(), "bad_node").when(a != F.col(service), "service_mismatch").when(b != F.col(metric), "metric_mismatch")
    return rows.withColumns({"issue": issue, "valid": issue.isNull(), "service_fixed": F.when(b.isNull(), F.col(service)).otherwise(a), "metric_fixed": F.coalesce(b, F.col(metric))})


def structure_prints(parts: DataFrame, snapshot: str, part: str) -> DataFrame:
    """(snapshot, print): a canonical fingerprint of each snapshot's distinct parts, whatever their order or repetition."""
    return parts.groupBy(snapshot).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_set(part))), 256).alias("print"))


def version_issues(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, valid_from, issue) of snapshots (snapshot_id, valid_from, valid_to, print, recorded), [from, to).

    changed_structure: the recorded fingerprint is not that of the structure; repeated_id: a second snapshot has the id; empty_interval: it
    ends before it begins; overlap: it begins before an earlier one has ended. Snapshots are few; those of all times are compared in one sorted run.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("valid_from", "valid_to").rowsBetween(Window.unboundedPreceding, -1)
    tests = [
        (~F.col("print").eqNullSafe(F.col("recorded")), "changed_structure"), (F.count("*").over(Window.partitionBy("snapshot_id")) > 1, "repeated_id"),
        (F.col("valid_to") <= F.col("valid_from"), "empty_interval"), (F.max("valid_to").over(w) > F.col("valid_from"), "overlap"),
    ]
    named = snapshots.withColumn("issues", F.array_compact(F.array(*[F.when(test, issue) for test, issue in tests])))
    return named.select("snapshot_id", "valid_from", F.explode("issues").alias("issue"))


def single_role(metrics: DataFrame, roles: DataFrame) -> DataFrame:
    """metrics (metric, source, one row each) with the roles that fit, and problem: no_role, several_roles or ok.

    A role (role, prefix, sources) fits a metric whose name begins with its prefix and whose source it lists. Roles are a table written by hand.
    """
    fits = F.col("metric").startswith(F.col("prefix")) & F.array_contains("sources", F.col("source"))
    joined = metrics.join(F.broadcast(roles), fits, "left").groupBy(*metrics.columns).agg(F.array_sort(F.collect_list("role")).alias("roles"))
    return joined.withColumn("problem", F.when(F.size("roles") == 0, "no_role").when(F.size("roles") > 1, "several_roles").otherwise("ok"))
