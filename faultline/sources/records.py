"""Reading and writing monitoring records; text ingest; change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

METRIC = T.StructType([T.StructField(n, T.DoubleType() if n in ("timestamp", "value") else T.StringType()) for n in ("timestamp", "service", "instance", "node", "metric", "value", "source", "incident_id")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a fixed schema; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Parquet, once: an existing folder is an error; the schema is checked if given."""
    if schema is not None and df.schema.simpleString() != schema.simpleString():
        raise ValueError(f"schema differs: {df.schema.simpleString()}")
    df.write.mode("errorifexists").parquet(path)


def enveloped(kind: str, df: DataFrame) -> DataFrame:
    """Lines {record_type, record} of a table."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("record_type"), F.struct(*sorted(df.columns)).alias("record"))).alias("value"))


def routed(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """Records of one type out of a mixed log; other types are left to other calls."""
    rows = lines.where(F.get_json_object("value", "$.record_type") == kind)
    return rows.select(F.from_json(F.get_json_object("value", "$.record"), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def exposition(lines: Column) -> dict[str, Column]:
    """Name, labels (as a map), value and time of exposition lines; a comment or bad line has a null name."""
    head = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?[0-9]+))?\s*$"
    labels = F.regexp_extract(lines, head, 2)
    pair = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    clean = lambda x: F.replace(F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    values = F.transform(F.regexp_extract_all(labels, F.lit(pair), F.lit(2)), clean)
    ok = ~lines.startswith("#") & lines.rlike(head)
    return {
        "name": F.when(ok, F.regexp_extract(lines, head, 1)), "labels": F.map_from_arrays(F.regexp_extract_all(labels, F.lit(pair), F.lit(1)), values),
        "value": F.when(ok, F.regexp_extract(lines, head, 3)).try_cast("double"), "ts_ms": F.when(ok, F.nullif(F.regexp_extract(lines, head, 4), F.lit(""))).try_cast("long"),
    }


def deduplicated(records: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """One row per key; keys whose payloads differ are flagged as conflicts."""
    h = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in payload]), 256)
    return records.withColumn("_h", h).groupBy(*key).agg(F.count_distinct("_h").alias("versions"), F.count("*").alias("copies")).withColumn("conflict", F.col("versions") > 1).drop("versions")


def out_of_order(records: DataFrame, stream: str, arrival: str, key: str) -> DataFrame:
    """Records that arrive after a later key of their stream."""
    before = F.max(key).over(Window.partitionBy(stream).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("late", F.coalesce(F.col(key) < before, F.lit(False)))


def current_objects(log: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """The last state of each object of a change log; deleted objects go."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col(event) != "DELETED")).drop("_r")


def event_windows(records: DataFrame, ts: Column, width: float, is_metric: Column) -> DataFrame:
    """Window end of each record: its own for metrics; the next one that has metrics for the rest (none: null)."""
    own = F.floor(ts / width)
    t = records.withColumn("_w", own).withColumn("_m", F.when(is_metric, own))
    first = t.where("_m is not null").select(F.col("_m").alias("window")).distinct()
    # the windows with metrics are one row a window; the others look up the next one
    spine = t.select("_w").distinct().join(first.withColumn("has", F.lit(True)), F.col("_w") == F.col("window"), "full_outer").select(F.coalesce("_w", "window").alias("_w"), "has")
    w = Window.partitionBy(F.lit(0)).orderBy("_w").rowsBetween(0, Window.unboundedFollowing)
    nxt = spine.select("_w", F.min(F.when(F.col("has"), F.col("_w"))).over(w).alias("window"))
    return t.drop("_m").join(nxt, "_w").drop("_w")


def cgroup_owner(chains: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """Follow owner edges (child, parent) from each start; the last owner reached, its depth, and whether a cycle stopped it."""
    front = chains.select(F.col("start"), F.col("start").alias("at"), F.array("start").alias("path"), F.lit(False).alias("cycle"))
    for _ in range(most):
        step = front.join(edges.select(F.col("child").alias("at"), "parent"), "at", "left")
        seen = F.coalesce(F.array_contains("path", F.col("parent")), F.lit(False))
        moves = F.col("parent").isNotNull() & ~seen & ~F.col("cycle")
        front = step.select("start", F.when(moves, F.col("parent")).otherwise(F.col("at")).alias("at"), F.when(moves, F.concat("path", F.array("parent"))).otherwise(F.col("path")).alias("path"), (F.col("cycle") | (seen & (F.col("parent") != F.col("at")))).alias("cycle"))
    return front.select("start", F.col("at").alias("owner"), (F.size("path") - 1).alias("depth"), "cycle")


def reports_to_write(reports: DataFrame, existing: DataFrame, key: str, payload: str) -> DataFrame:
    """Reports with what to do: new, unchanged or conflict with what is stored under the id."""
    old = existing.select(key, F.col(payload).alias("_old"))
    what = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(payload), "unchanged").otherwise("conflict")
    return reports.join(old, key, "left").withColumn("action", what).drop("_old")


def kernel_events(lines: Column) -> Column:
    """A typed event out of a JSON line; null where it is malformed."""
    return F.from_json(lines, "event_id long, type string, cgroup string, value double, cpu int, seq long")


def call_edges(samples: DataFrame, edge: list[str], identity: str, value: str) -> DataFrame:
    """Per edge the sum over its samples, each counted once, and what came in conflict.

    Samples of the same edge and identity with the same value are one; with differing values they are a conflict and none counts. Without
    any value they are neither.
    The sources are kept as their first, their last and an order-free sum, which tells sets apart without holding them.
    """
    one = samples.groupBy(*edge, identity).agg(F.min(value).alias("_value"), F.max(value).alias("_most"))
    good = F.col("_value") == F.col("_most")
    take = lambda c: F.when(good, c)
    return one.groupBy(*edge).agg(
        F.coalesce(F.sum(take(F.col("_value"))), F.lit(0.0)).alias("total"), F.count_if(good).alias("samples"), F.count_if(~good).alias("conflicts"),
        F.min(take(F.col(identity))).alias("first_source"), F.max(take(F.col(identity))).alias("last_source"), F.sum(take(F.col(identity) % 1000003)).alias("sources"),
    )
