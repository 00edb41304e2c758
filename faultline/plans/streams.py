"""Queries that run a stream over files of the given tables to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.tables import scratch, spread_width, written
from faultline.streaming import windows as W

from .views import query

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed_through(v, rows: DataFrame, build, sink, parts: int = 4, cuts: list[float] | None = None):
    """build(stream) into sink when ``rows`` arrive in ranges of the column ``ord`` (up to each of cuts, or ``parts`` of about equal
    size): each range is appended to a folder and drained by a run of the same query, which goes on from the checkpoint of the run before."""
    folder = scratch(v.spark, "stream")
    rows = written(rows.withColumn("ord", F.col("ord").cast("double")))
    if cuts is None:
        cuts = rows.agg(F.percentile_approx("ord", [i / parts for i in range(1, parts)])).first()[0] or []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    for lo, hi in zip(edges, edges[1:]):
        rows.where((F.col("ord") > lo) & (F.col("ord") <= hi)).write.mode("append").parquet(f"{folder}/in")
        stream = build(v.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        W.drained(stream, f"{folder}/checkpoint", sink)
    return stream.schema


def replayed(v, rows: DataFrame, build, parts: int = 4) -> DataFrame:
    """The rows that build(stream) appends when ``rows`` arrive in ranges of the column ``ord``."""
    out = scratch(v.spark, "stream")
    schema = replayed_through(v, rows, build, lambda batch, _: batch.write.mode("append").parquet(out), parts)
    return v.spark.read.schema(schema).parquet(out)


def events(v) -> DataFrame:
    return v.metrics().select("event_id", "service", "metric", "instance", "timestamp", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("ts"), "value", F.col("timestamp").alias("ord"))


@query("str_01_watermarked_windows", "SELECT service, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n, sum(total) AS total FROM (SELECT service, floor(timestamp/86400) AS d, count(*) AS n, sum(value) AS total FROM v_metrics GROUP BY 1,2) GROUP BY 1")
def _(v):
    closing = v.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("closing").alias("service"), F.lit("m").alias("metric"), F.lit("i").alias("instance"), F.lit(1.9e9).alias("timestamp"), F.timestamp_seconds(F.lit(1900000000)).alias("ts"), F.lit(0.0).alias("value"), F.lit(1.9e9).alias("ord"))
    out = replayed(v, events(v).unionByName(closing), lambda stream: W.windowed(stream, "ts", "1 day", "30 days", ["service"]))
    return out.where("service <> 'closing'").groupBy("service").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("str_03_idle_windows", "WITH r AS (SELECT service, CAST(floor(timestamp/21600) AS BIGINT) AS win, metric FROM v_metrics), s AS (SELECT service, min(win) AS a, max(win) AS b FROM r GROUP BY 1) SELECT s.service, count(*) AS missing FROM (SELECT service, unnest(range(a, b+1)) AS win FROM s) s CROSS JOIN (SELECT DISTINCT metric FROM r) m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.service=s.service AND r.win=s.win AND r.metric=m.metric) GROUP BY 1")
def _(v):
    rows = v.metrics().select("service", F.floor(F.col("timestamp") / 21600).alias("win"), F.col("metric").alias("component"))
    idle = W.idle_windows(rows, "service", "win", rows.select("component").distinct())
    return idle.where("issue is not null").groupBy("service").agg(F.count("*").alias("missing"))


def _with_store(v):
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


@query("str_04_stateful_delta", "SELECT issue, count(*) AS n, sum(CASE WHEN value>=prev THEN value-prev END) AS total FROM (SELECT *, CASE WHEN prev IS NULL THEN 'no_history' WHEN value<prev THEN 'counter_reset' END AS issue FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY timestamp, event_id) AS prev FROM v_counter)) GROUP BY 1")
def _(v):
    _with_store(v)
    rows = v.counter().select("series_id", (F.col("timestamp") + F.col("event_id") * 1e-9).alias("ts"), "value", F.col("timestamp").alias("ord"))
    bucket = F.pmod(F.xxhash64("series_id"), F.lit(spread_width(v.table("events"), 20_000)))
    out = replayed(v, rows, lambda stream: W.stateful(stream.drop("ord").withColumn("bucket", bucket), "bucket", W.CounterDelta()))
    return out.groupBy("issue").agg(F.count("*").alias("n"), F.sum("delta").alias("total"))


@query("str_05_stateful_baseline")
def _(v):
    _with_store(v)
    return replayed(v, v.metrics().select(F.concat_ws(".", "service", "metric").alias("key"), F.col("timestamp").alias("ts"), "value", F.col("timestamp").alias("ord")), lambda stream: W.stateful(stream.drop("ord"), "key", W.HealthyBuffer()))


@query("str_06_stateful_alerts", "SELECT service, state, count(*) AS n FROM v_states GROUP BY 1,2")
def _(v):
    from .alerts import daily

    _with_store(v)
    w = daily(v).groupBy("service", "win").agg(F.max("score").alias("score"))
    out = replayed(v, w.select(F.col("service").alias("key"), F.col("win").cast("double").alias("at"), "score", F.col("win").alias("ord")), lambda stream: W.stateful(stream.drop("ord"), "key", W.AlertMachine(1.5, 3.0, 2, 2, 2, 1)))
    return out.groupBy(F.col("key").alias("service"), "state").agg(F.count("*").alias("n"))


@query("str_08_delayed_diagnosis", "SELECT a.service, count(*) AS pairs, count(DISTINCT a.event_id) AS alerts FROM v_metrics a JOIN v_metrics e ON a.service=e.service AND e.timestamp>=a.timestamp AND e.timestamp<=a.timestamp+7200 WHERE a.metric='request.error_rate' AND a.value>150 AND e.metric='net.retrans' GROUP BY 1")
def _(v):
    e = events(v)

    def build(stream):
        alerts = stream.where("metric = 'request.error_rate' and value > 150").select(F.col("event_id").alias("alert_id"), "service", F.col("ts").alias("alert_ts"))
        found = stream.where("metric = 'net.retrans'").select("service", F.col("ts").alias("evidence_ts"), "value")
        return W.delayed_diagnosis(alerts, found, "2 hours", "40 days")

    out = replayed(v, e, build)
    return out.groupBy("service").agg(F.count("*").alias("pairs"), F.count_distinct("alert_id").alias("alerts"))
