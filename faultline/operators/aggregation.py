"""Counters, histograms and window roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling(ts: Column, width: float) -> Column:
    """Start of the half-open window that holds ts."""
    return (F.floor(ts / width) * width).cast("double")


def counter_delta(rows: DataFrame, series: str, order: list[str], policy: str = "missing") -> DataFrame:
    """delta and issue of a monotonic counter: the first sample has no history; a reset is missing, or taken as it is (policy "current")."""
    before = F.lag("value").over(Window.partitionBy(series).orderBy(*order))
    d = F.col("value") - before
    issue = F.when(before.isNull(), "no_history").when(d < 0, "counter_reset")
    reset = F.col("value") if policy == "current" else F.lit(None).cast("double")
    return rows.withColumns({"delta": F.when(d < 0, reset).otherwise(d), "issue": issue})


def reject_reset_windows(deltas: DataFrame, window: str) -> DataFrame:
    """Rows of windows without any reset."""
    bad = deltas.where("issue = 'counter_reset'").select(window).distinct()
    return deltas.join(bad, window, "left_anti")


def sum_same_unit(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Sum per key; several units are an issue instead of a value."""
    t = rows.groupBy(*keys).agg(F.sum("value").alias("total"), F.count_distinct(unit).alias("units"))
    return t.select(*keys, F.when(F.col("units") == 1, F.col("total")).alias("total"), F.when(F.col("units") > 1, "mixed_units").alias("issue"))


def median_max(rows: DataFrame, keys: list[str], weight: float) -> DataFrame:
    return rows.groupBy(*keys).agg((weight * F.percentile("value", 0.5) + (1 - weight) * F.max("value")).alias("value"))


def last_value(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest value per key; several values at the latest time are a conflict."""
    top = rows.withColumn("last_at", F.max(order).over(Window.partitionBy(*keys))).where(F.col(order) == F.col("last_at"))
    return top.groupBy(*keys, "last_at").agg(F.max("value").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def safe_ratio(n: Column, d: Column, bounded: bool = False, eps: float = 1e-9) -> tuple[Column, Column]:
    """(value, status): 0/0 is zero without coverage; n over nothing, or a bounded ratio above 1, is an error."""
    bad = (n > 0) & (d <= 0)
    value = F.when(bad, None).when(d <= 0, 0.0).otherwise(n / (d + eps))
    status = F.when(bad, "no_denominator").when(d <= 0, "no_coverage")
    if bounded:
        status = status.when(n > d, "above_one")
        value = F.when((d > 0) & (n > d), None).otherwise(value)
    return value, status.otherwise("ok")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, bound: str = "le", count: str = "cum_count") -> DataFrame:
    """Quantile of cumulative buckets: the first bound that reaches q of the total; beyond the last finite bound, that bound and an issue.

    An empty histogram is 0 without coverage; counts that fall along the bounds are an issue.
    """
    w = Window.partitionBy(*keys).orderBy(bound)
    total = F.max(count).over(Window.partitionBy(*keys))
    marked = buckets.withColumns({"total": total, "falls": F.lag(count).over(w) > F.col(count)})
    finite = F.when(F.col(bound) < float("inf"), F.col(bound))
    t = marked.groupBy(*keys, "total").agg(
        F.min(F.when(F.col(count) >= q * F.col("total"), F.col(bound))).alias("at"), F.max(finite).alias("last"), F.bool_or(F.coalesce("falls", F.lit(False))).alias("falls")
    )
    value = F.when(F.col("total") == 0, 0.0).when(F.col("at") == float("inf"), F.col("last")).otherwise(F.col("at"))
    issue = F.when(F.col("falls"), "not_monotone").when(F.col("total") == 0, "empty").when(F.col("at") == float("inf"), "above_last_bound")
    return t.select(*keys, value.alias("value"), issue.alias("issue"), "total")


def quality_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sample-weighted coverage and loss."""
    n = F.greatest("n", F.lit(1))
    return rows.groupBy(*keys).agg((F.sum(n * F.col("coverage")) / F.sum(n)).alias("coverage"), (F.sum(n * F.col("loss")) / F.sum(n)).alias("loss"), F.sum("n").alias("n"))


def run_plan(specs: dict[str, tuple[list[str], Callable[..., DataFrame]]], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Outputs of a small table of specs {name: (needed names, build)}: each is built once what it needs is there."""
    done = dict(inputs)
    left = dict(specs)
    while left:
        ready = [k for k, (need, _) in left.items() if all(n in done for n in need)]
        if not ready:
            raise ValueError(f"unknown inputs or a cycle among {sorted(left)}")
        for k in ready:
            need, build = left.pop(k)
            done[k] = build(*[done[n] for n in need])
    return done


def boundary_delta(samples: DataFrame, keys: list[str], series: str, start: Column, end: Column) -> DataFrame:
    """Delta per key and series from exactly one sample at each end; otherwise an issue."""
    at = lambda t: F.count(F.when(F.col("timestamp") == t, 1))
    value = lambda t: F.sum(F.when(F.col("timestamp") == t, F.col("value")))
    t = samples.groupBy(*keys, series).agg(at(start).alias("a"), at(end).alias("b"), (value(end) - value(start)).alias("d"))
    issue = F.when((F.col("a") != 1) | (F.col("b") != 1), "boundary_samples").when(F.col("d") < 0, "counter_reset")
    return t.select(*keys, series, F.when(issue.isNull(), F.col("d")).alias("delta"), issue.alias("issue"))


def series_sets_equal(rows: DataFrame, keys: list[str], component: str, series: str) -> DataFrame:
    """Per key: do all components have the same set of series."""
    sets = rows.groupBy(*keys, component).agg(F.sort_array(F.collect_set(series)).alias("s"))
    return sets.groupBy(*keys).agg((F.size(F.collect_set("s")) == 1).alias("equal"), F.count("*").alias("components"))


def lineage(rows: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """Union of source ids, least coverage and largest loss."""
    return rows.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(ids)))).alias("sources"), F.min("coverage").alias("coverage"), F.max("loss").alias("loss"))


def edge_rollup(calls: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """count, p95 latency and failure rate of each directed edge; known edges without calls stay with zero coverage."""
    t = calls.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by latency)").alias("p95"), F.sum("failed").alias("failed"))
    if known is not None:
        t = known.join(t, keys, "left").fillna({"n": 0, "failed": 0})
    rate, status = safe_ratio(F.col("failed"), F.col("n"), bounded=True)
    return t.withColumns({"failure_rate": rate, "status": status})


def request_summary(samples: DataFrame, keys: list[str], latency: str, failed: str) -> DataFrame:
    """Requests, error rate and nearest-rank p50, p95, p99."""
    pick = lambda q: F.expr(f"percentile_disc({q}) within group (order by {latency})")
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(failed).alias("error_rate"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


def phase_lift(rows: DataFrame, keys: list[str], faulty: Column) -> DataFrame:
    """Mean and deviation in each phase, the lift, and its rank over all keys of a run."""
    on = lambda test: F.when(test, F.col("value"))
    t = rows.groupBy(*keys).agg(F.avg(on(~faulty)).alias("baseline_mean"), F.avg(on(faulty)).alias("faulty_mean"), F.stddev_pop(on(~faulty)).alias("baseline_std"), F.stddev_pop(on(faulty)).alias("faulty_std"))
    return t.withColumn("lift", F.col("faulty_mean") - F.col("baseline_mean"))


def high_water(samples: DataFrame, series: str, snapshot: str, value: str, spine: DataFrame) -> DataFrame:
    """Running maximum of each series at every snapshot of the spine from its first sample on."""
    first = samples.groupBy(series).agg(F.min(snapshot).alias("first"))
    grid = first.join(spine, F.col(snapshot) >= F.col("first")).select(series, snapshot)
    best = samples.groupBy(series, snapshot).agg(F.max(value).alias(value))
    w = Window.partitionBy(series).orderBy(snapshot).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(best, [series, snapshot], "left").select(series, snapshot, F.max(value).over(w).alias("high"))
