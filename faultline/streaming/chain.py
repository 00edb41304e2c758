"""The chain of operators.chain over a stream: one foreachBatch job with transactional state between the stages.

Each micro-batch writes its outputs and the state that it leaves into a folder of its own, then a marker. A batch that ends
before its marker is done again from the state of the batch before and overwrites what it had written; a batch that Spark
repeats after its marker is left alone. So each window is scored, learned and diagnosed once, whatever is restarted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import chain as C
from faultline.operators.tables import committed, mark, removed

CLOCK = "top double, final long"
STATES = {"open": C.OPEN, "memory": C.MEMORY, "recent": C.RECENT, "alerts": C.ALERTS, "models": C.MODELS, "clock": CLOCK}
OUTPUTS = {
    "late": "service string, metric string, timestamp double, value double, win long", "scores": "service string, metric string, win long, value double, score double", "timeline": "service string, win long, score double, ready boolean, previous string, state string",
    "predictions": "service string, win long, predicted double, residual double, ready boolean, reason string", "reports": "service string, win long, status string, reason string, rank int, root_service string, root_metric string, root_score double, hop int",
}


class Chain:
    """Call it with each micro-batch (service, metric, timestamp, value). parents (parent, target) and reach (seed, node, hop) are the topology.

    A window is final once ``lateness`` seconds beyond its end have been seen; rows for final windows go to the output late.
    before_commit is called with the batch id when all is written but the marker.
    """

    def __init__(self, folder: str, parents: DataFrame, reach: DataFrame, rule: C.Rule, before_commit: Callable[[int], None] = lambda _: None):
        self.folder, self.parents, self.reach, self.rule, self.before_commit = folder, parents, reach, rule, before_commit

    def __call__(self, batch: DataFrame, batch_id: int, closing: bool = False) -> None:
        spark = batch.sparkSession
        done = committed(spark, self.folder)
        if batch_id in done:
            return
        previous = max(done, default=None)

        def state(name: str) -> DataFrame:
            return spark.createDataFrame([], STATES[name]) if previous is None else spark.read.schema(STATES[name]).parquet(f"{self.folder}/batch={previous}/{name}")

        def put(name: str, df: DataFrame) -> DataFrame:
            path = f"{self.folder}/batch={batch_id}/{name}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        rule = self.rule
        rows = put("rows", batch.select("service", "metric", "timestamp", "value", F.floor(F.col("timestamp") / rule.width).alias("win")))
        clock = state("clock").first()
        final = clock["final"] if clock else None
        top = max([x for x in (clock["top"] if clock else None, rows.agg(F.max("timestamp")).first()[0]) if x is not None], default=None)
        last = None if top is None else int((top - rule.lateness) // rule.width) - 1
        if closing and top is not None:
            last = int(top // rule.width)
        last = max([x for x in (last, final) if x is not None], default=None)
        put("late", rows.where(F.lit(False) if final is None else F.col("win") <= final))
        open_ = put("accumulated", C.accumulated(state("open"), rows if final is None else rows.where(F.col("win") > final)))
        shut = F.lit(False) if last is None else F.col("win") <= last
        put("open", open_.where(~shut))
        scores, memory = C.scored(open_.where(shut), state("memory"), rule)
        scores = put("scores", scores)
        put("memory", memory)
        timeline, alerts = C.alerted(scores, state("alerts"), rule)
        timeline = put("timeline", timeline)
        put("alerts", alerts)
        model, recent, _ = C.modelled(timeline, state("recent"), state("models"), self.parents, final, rule)
        model = put("model", model)
        put("recent", recent)
        put("models", model.where("model is not null").select("service", "model"))
        predictions = put("predictions", model.where("win is not null").drop("model"))
        put("reports", C.diagnosed(timeline, scores, predictions, self.reach, rule))
        put("clock", spark.createDataFrame([(top, last)], CLOCK))
        self.before_commit(batch_id)
        mark(spark, f"{self.folder}/batch={batch_id}/_COMMITTED")
        for name in ([*STATES, "rows", "accumulated", "model"] if previous is not None else ()):
            removed(spark, f"{self.folder}/batch={previous}/{name}")

    def finish(self, spark: SparkSession) -> None:
        """Closes the windows that are still open, at the end of a bounded stream."""
        ids = committed(spark, self.folder)
        self(spark.createDataFrame([], "service string, metric string, timestamp double, value double"), max(ids, default=-1) + 1, closing=True)


def results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of an output of all committed batches."""
    paths = [f"{folder}/batch={i}/{name}" for i in committed(spark, folder)]
    return spark.read.schema(OUTPUTS[name]).parquet(*paths) if paths else spark.createDataFrame([], OUTPUTS[name])
