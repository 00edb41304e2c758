"""Model lifecycles: which model an alert prepares, freezes, archives or recovers, from a cache keyed by alert and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uses(events: DataFrame, cache: int) -> DataFrame:
    """Soft and hard events (service, win, state, fingerprint) with ``cached``: the model of this service and these candidates is still held.

    A service's cache holds the ``cache`` combinations used last; one falls out when as many others have been used since.
    """
    u = events.where(F.col("state").isin("soft", "hard"))
    last = F.lag("win").over(Window.partitionBy("service", "fingerprint").orderBy("win"))
    a = u.withColumn("last", last)
    b = u.select("service", F.col("win").alias("other_win"), F.col("fingerprint").alias("other"))
    since = a.where("last is not null").join(b, "service").where("other_win > last and other_win < win").groupBy("service", "win").agg(F.count_distinct("other").alias("others"))
    return a.join(since, ["service", "win"], "left").withColumn("cached", F.col("last").isNotNull() & (F.coalesce("others", F.lit(0)) < cache)).drop("last", "others")


def transitions(events: DataFrame, cache: int = 8) -> DataFrame:
    """One row for each change of an alert state (service, win, state, fingerprint) with its action, the status it leaves and the model it is about.

    soft prepares a model: the cached one of the service and candidates, or a new fit. hard freezes the active one if the candidates are
    those that it was prepared or frozen for; otherwise it is rebuilt, or fitted where no model was active. healthy after a soft alert
    archives what was prepared; recovery releases the frozen model. fitted_at is the window of the fit, whose training ends
    before it; version counts the fits for the same service and candidates. (…, action, status, fitted_at, version)
    """
    order = Window.partitionBy("service").orderBy("win")
    flagged = events.join(uses(events, cache).select("service", "win", "cached"), ["service", "win"], "left")
    steps = flagged.withColumns({"before": F.lag("state").over(order), "held": F.last(F.when(F.col("state").isin("soft", "hard"), F.col("fingerprint")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    same = F.col("before").isin("soft", "recovery") & (F.col("held") == F.col("fingerprint"))
    action = (
        F.when(F.col("state") == "soft", F.when(F.col("cached"), "prepare_cached").otherwise("prepare"))
        .when(F.col("state") == "hard", F.when(same, "freeze").when(F.col("before").isin("soft", "recovery"), "rebuild").otherwise("freeze_unprepared"))
        .when(F.col("state") == "recovery", "recover").when(F.col("before") == "soft", "archive").otherwise("close")
    )
    status = F.when(F.col("state") == "soft", "PREPARED").when(F.col("state") == "hard", "FROZEN").when(F.col("action") == "archive", "ARCHIVED").otherwise("RECOVERED")
    rows = steps.withColumn("action", F.coalesce(action, F.lit("close"))).withColumn("status", status)
    fit = F.col("action").isin("prepare", "rebuild", "freeze_unprepared")
    key = Window.partitionBy("service", "fingerprint", F.col("state").isin("soft", "hard")).orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"_fitted": F.when(F.col("state").isin("soft", "hard"), F.max(F.when(fit, F.col("win"))).over(key)), "_version": F.when(F.col("state").isin("soft", "hard"), F.count(F.when(fit, 1)).over(key))})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda c: F.last(c, ignorenulls=True).over(upto)
    return own.select("service", "win", "state", kept(F.when(F.col("_fitted").isNotNull(), F.col("fingerprint"))).alias("fingerprint"), "action", "status", kept("_fitted").alias("fitted_at"), kept("_version").alias("version"))


def trained(windows: DataFrame, penalty: float = 1.0, least: int = 10) -> DataFrame:
    """For each window of a service the model that a fit there would give: from the healthy windows before it alone.

    windows: (service, win, score, state), one row each. The model is a ridge line of a score on the one before; its sums run along the
    windows, so that each fit reads one row. (service, win, rows, slope, intercept, ready)
    """
    w = Window.partitionBy("service").orderBy("win")
    pairs = windows.withColumn("x", F.lag("score").over(w)).withColumn("ok", (F.col("state") == "healthy") & F.col("x").isNotNull())
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.coalesce(F.sum(F.when(F.col("ok"), e)).over(past), F.lit(0.0)) for n, e in {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("score"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("score")}.items()}
    t = pairs.withColumns(sums)
    slope = F.when(F.col("n") > 0, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n") + penalty))
    return t.withColumn("slope", slope).select("service", "win", F.col("n").cast("long").alias("rows"), "slope", F.when(F.col("n") > 0, (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), (F.col("n") >= least).alias("ready"))
