"""Monitoring views over the given tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators.tables import spread_width, written

#: Event type to metric name.
METRIC_OF = {"error": "request.error_rate", "view": "request.p99_latency_ms", "click": "cpu.throttled_usec", "purchase": "net.retrans", "signup": "io.write_bytes"}
DAY0 = 1704067200.0  # 2024-01-01
BOUNDS = (50.0, 100.0, 200.0, 400.0)
RESET_EVERY = 8

SQL: dict[str, str] = {}


def with_views(body: str) -> str:
    """The query with the views that it names put in front as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in SQL and name not in need:
                visit(SQL[name])
                if name not in need:
                    need.append(name)

    visit(body)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    body = body.strip()
    recursive = "RECURSIVE " if re.match(r"(?i)WITH RECURSIVE\b", body) else ""
    rest = re.match(r"(?is)WITH\s+(?:RECURSIVE\s+)?(.*)", body)
    if not head:
        return body
    return f"WITH {recursive}{head}, {rest[1]}" if rest else f"WITH {head} {body}"


class Views:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage that several parts of a query read: written on first use, then read."""
        if name not in self._kept:
            self._kept[name] = written(build())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def metrics(self) -> DataFrame:
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
        names = F.create_map(*[F.lit(x) for kv in METRIC_OF.items() for x in kv])
        return self.table("events").select(
            "event_id", (micros / 1e6).alias("timestamp"), F.concat(F.lit("svc"), (F.col("user_id") % 11).cast("string")).alias("service"),
            F.col("user_id").cast("string").alias("instance"), F.concat(F.lit("node"), (F.col("user_id") % 3).cast("string")).alias("node"),
            names[F.col("event_type")].alias("metric"), "value", F.lit("events").alias("source"), F.lit(None).cast("string").alias("incident_id"),
        )

    def panel(self) -> DataFrame:
        hour = (F.floor(F.col("timestamp") / 3600) * 3600).cast("double")
        return self.metrics().groupBy(hour.alias("ts"), "service", "metric").agg(F.avg("value").alias("value")).withColumn("node_id", F.concat_ws(".", "service", "metric"))

    def counter(self) -> DataFrame:
        order = Window.partitionBy("series_id").orderBy("timestamp", "event_id")
        rows = self.metrics().withColumn("series_id", F.concat_ws("/", "instance", "metric")).withColumn("part", F.floor((F.row_number().over(order) - 1) / RESET_EVERY))
        run = Window.partitionBy("series_id", "part").orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("series_id", "service", "metric", "event_id", "timestamp", F.sum("value").over(run).alias("value"))

    def bucket(self) -> DataFrame:
        bounds = F.array(*[F.lit(b) for b in BOUNDS], F.lit(float("inf")))
        hour = F.floor((F.col("timestamp") - DAY0) / 3600).cast("long")
        rows = self.metrics().select("service", hour.alias("hour"), "value", F.explode(bounds).alias("le"))
        return rows.groupBy("service", "hour", "le").agg(F.sum((F.col("value") <= F.col("le")).cast("long")).alias("cum_count"))

    def incidents(self) -> DataFrame:
        i = F.col("id")
        start = F.lit(DAY0) + (4 * i - 1) * 86400.0 + 6 * 3600.0
        metric = F.when(i % 3 == 0, "cpu.throttled_usec").when(i % 3 == 1, "net.retrans").otherwise("io.write_bytes")
        kind = F.when(i % 3 == 0, "CPU").when(i % 3 == 1, "network").otherwise("storage I/O")
        svc = lambda x: F.concat(F.lit("svc"), x.cast("string"))
        return self.spark.range(1, 7, 1, 1).select(
            F.concat(F.lit("inc"), i.cast("string")).alias("incident_id"), svc(i).alias("root_service"), metric.alias("root_metric"), kind.alias("root_type"),
            F.lit("svc0").alias("symptom_service"), start.alias("start_ts"), (start + 43200.0).alias("end_ts"), F.array(svc(i), svc(i + 1), F.lit("svc0")).alias("injected_path"),
        )

    def call_rows(self, dealt: bool = False) -> DataFrame:
        """The calls; dealt by request over partitions of a bounded size, for what groups rows of single requests."""
        li = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        cust = self.table("customer").select("c_custkey", "c_nationkey")
        supp = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        placed, served = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")), li.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        if dealt:
            width = spread_width(li)
            placed, served = placed.repartition(width, "o_orderkey"), served.repartition(width, "l_orderkey")
        rows = served.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        a, b = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"))
        return rows.join(a, "c_nationkey").join(b, "s_nationkey").select(
            "src", "dst", "month", F.col("l_quantity").alias("latency"), (F.col("l_returnflag") == "R").cast("long").alias("failed"), F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("line")
        )

    def calls(self) -> DataFrame:
        return self.call_rows().groupBy("src", "dst", "month").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by latency)").alias("p95"), F.sum("failed").alias("failed"))

    def graph(self) -> DataFrame:
        totals = self.call_rows().groupBy("src", "dst").agg(F.count("*").alias("n")).where("src <> dst")
        i = F.col("user_id")
        svc = lambda x: F.concat(F.lit("svc"), (x % 11).cast("string"))
        ring = self.table("events").select(svc(i).alias("src"), svc(i + 1).alias("dst")).distinct().select("src", "dst", F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
        return totals.select("src", "dst", F.lit("trace").alias("edge_type"), (F.col("n") / 1000.0).alias("weight")).unionByName(ring)

    def placement(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("service"), F.col("r_name").alias("node"))
        return a.unionByName(self.metrics().select("service", "node").distinct())

    def snapshots(self) -> DataFrame:
        rows = self.call_rows().groupBy(F.substring("month", 1, 4).cast("int").alias("year"), "src", "dst").agg(F.count("*").alias("n"))
        at = lambda y: F.datediff(F.make_date(y, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("double") * 86400.0
        return rows.where("src <> dst").select(F.concat(F.lit("y"), F.col("year").cast("string")).alias("snapshot_id"), at(F.col("year")).alias("valid_from"), at(F.col("year") + 1).alias("valid_to"), "src", "dst", "n")

    def intervals(self) -> DataFrame:
        day = F.floor((F.col("timestamp") - DAY0) / 86400).cast("long")
        return self.metrics().groupBy(F.col("instance").alias("cgroup"), "service", day.alias("day")).agg(F.min("timestamp").alias("valid_from"), F.max("timestamp").alias("valid_to"))

    def residuals(self) -> DataFrame:
        """Rows around each incident with a standard score as residual and a sampling probability by family."""
        m = self.metrics()
        stats = m.groupBy("service", "metric").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
        p = F.when(F.col("metric").startswith("request."), 1.0).when(F.col("metric") == "cpu.throttled_usec", 0.4).otherwise(0.1)
        near = m.join(F.broadcast(self.incidents().select(F.col("incident_id").alias("inc"), "start_ts", "end_ts")), (F.col("timestamp") >= F.col("start_ts") - 86400.0) & (F.col("timestamp") <= F.col("end_ts")))
        return near.join(stats, ["service", "metric"]).select(
            F.col("inc").alias("incident_id"), "event_id", "timestamp", "service", "metric", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("residual"), p.alias("probability"), "start_ts", "end_ts"
        )


SQL["v_metrics"] = """SELECT event_id, epoch_us(ts)/1e6 AS timestamp, 'svc'||(user_id%11) AS service, CAST(user_id AS VARCHAR) AS instance, 'node'||(user_id%3) AS node,
 CASE event_type WHEN 'error' THEN 'request.error_rate' WHEN 'view' THEN 'request.p99_latency_ms' WHEN 'click' THEN 'cpu.throttled_usec' WHEN 'purchase' THEN 'net.retrans' WHEN 'signup' THEN 'io.write_bytes' END AS metric,
 value, 'events' AS source, CAST(NULL AS VARCHAR) AS incident_id FROM events"""
SQL["v_panel"] = "SELECT floor(timestamp/3600)*3600 AS ts, service, metric, avg(value) AS value, service||'.'||metric AS node_id FROM v_metrics GROUP BY 1,2,3,5"
SQL["v_counter"] = """SELECT series_id, service, metric, event_id, timestamp, sum(value) OVER (PARTITION BY series_id, part ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS value
 FROM (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY timestamp, event_id) - 1)//8 AS part FROM (SELECT *, instance||'/'||metric AS series_id FROM v_metrics))"""
SQL["v_bucket"] = """SELECT service, CAST(floor((timestamp-1704067200)/3600) AS BIGINT) AS hour, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS cum_count
 FROM v_metrics CROSS JOIN (SELECT unnest([50.0,100.0,200.0,400.0,'inf'::DOUBLE]::DOUBLE[]) AS le) GROUP BY 1,2,3"""
SQL["v_incidents"] = """SELECT 'inc'||i AS incident_id, 'svc'||i AS root_service, CASE i%3 WHEN 0 THEN 'cpu.throttled_usec' WHEN 1 THEN 'net.retrans' ELSE 'io.write_bytes' END AS root_metric,
 CASE i%3 WHEN 0 THEN 'CPU' WHEN 1 THEN 'network' ELSE 'storage I/O' END AS root_type, 'svc0' AS symptom_service, 1704067200.0::DOUBLE + (4*i-1)*86400 + 21600 AS start_ts, 1704067200.0::DOUBLE + (4*i-1)*86400 + 64800 AS end_ts,
 ['svc'||i, 'svc'||(i+1), 'svc0'] AS injected_path FROM range(1,7) t(i)"""
SQL["v_call_rows"] = """SELECT a.n_name AS src, b.n_name AS dst, strftime(o_orderdate, '%Y-%m') AS month, l_quantity AS latency, CAST(l_returnflag='R' AS BIGINT) AS failed, l_orderkey AS request_id, l_linenumber AS line
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation a ON c_nationkey=a.n_nationkey JOIN nation b ON s_nationkey=b.n_nationkey"""
SQL["v_calls"] = "SELECT src, dst, month, count(*) AS n, quantile_disc(latency, 0.95) AS p95, CAST(sum(failed) AS BIGINT) AS failed FROM v_call_rows GROUP BY 1,2,3"
SQL["v_graph"] = """SELECT src, dst, 'trace' AS edge_type, n/1000.0 AS weight FROM (SELECT src, dst, count(*) AS n FROM v_call_rows WHERE src<>dst GROUP BY 1,2)
 UNION ALL SELECT DISTINCT 'svc'||(user_id%11), 'svc'||((user_id+1)%11), 'call', 1.0 FROM events"""
SQL["v_placement"] = "SELECT n_name AS service, r_name AS node FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT DISTINCT service, node FROM v_metrics"
SQL["v_snapshots"] = """SELECT 'y'||y AS snapshot_id, epoch(make_date(y,1,1)) AS valid_from, epoch(make_date(y+1,1,1)) AS valid_to, src, dst, n
 FROM (SELECT CAST(substr(month,1,4) AS INT) AS y, src, dst, count(*) AS n FROM v_call_rows WHERE src<>dst GROUP BY 1,2,3)"""
SQL["v_intervals"] = "SELECT instance AS cgroup, service, CAST(floor((timestamp-1704067200)/86400) AS BIGINT) AS day, min(timestamp) AS valid_from, max(timestamp) AS valid_to FROM v_metrics GROUP BY 1,2,3"
SQL["v_residuals"] = """SELECT i.incident_id, event_id, timestamp, m.service, m.metric, (value-mu)/sd AS residual, CASE WHEN m.metric LIKE 'request.%' THEN 1.0 WHEN m.metric='cpu.throttled_usec' THEN 0.4 ELSE 0.1 END AS probability, start_ts, end_ts
 FROM v_metrics m JOIN v_incidents i ON timestamp >= start_ts-86400 AND timestamp <= end_ts JOIN (SELECT service, metric, avg(value) AS mu, stddev_pop(value) AS sd FROM v_metrics GROUP BY 1,2) s ON s.service=m.service AND s.metric=m.metric"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the views under its name, with the same query as SQL where SQL has it."""

    def add(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql:
            ORACLE[name] = with_views(sql)
        return build

    return add
