"""Mixing sources to target token weights by entropy balancing, all in DataFrame operations.

A document of ``size`` words gets the rate min(cap, exp(lambda * size / scale)) of its
source; the convex dual in lambda is solved by Newton steps, each one distributed sum
over the (source, size) histogram. Rates are then rounded into whole copies so that the
words taken meet the target of each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, words, written

#: Newton steps at most, and steps in one job.
ROUNDS, STEPS = 60, 4
#: Parts in which the documents of a (source, size) cell are ranked.
SALTS = 256
#: Newton stops when no source is off by more than this share of its target.
TOLERANCE = 1e-6


def source_key(source: Column) -> Column:
    """A sortable key without nulls: code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source_size) plus target: ``share`` of all sizes dealt by weight, none above ``cap`` times its source.

    The weights repeat over the sources in key order. Water filling in closed form: in the
    order of cap * size / weight, sources are full as long as that is no more than the
    level of those that follow. The table has one row for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    weighed = sources.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(everything.orderBy("key")) - 1) % len(weights)])
    full = F.lit(cap) * F.col("source_size")
    order = everything.orderBy(full / F.col("w"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levelled = weighed.withColumn("level", level).withColumn("open", full > F.col("level") * F.col("w"))
    final = F.min(F.when(F.col("open"), F.struct(full / F.col("w"), F.col("key"), F.col("level")))).over(everything)["level"]
    return levelled.withColumn("final", final).select("key", "source_size", F.when(F.col("open"), F.col("final") * F.col("w")).otherwise(full).alias("target"))


def newton(cells: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One guarded Newton step for every source: halving or doubling where the step leaves the bracket."""
    x = F.col("size") / F.col("scale")
    bound = F.lit(math.log(cap))
    rate = F.exp(F.least(F.col("lam") * x, bound))
    sums = cells.join(state, "key").groupBy("key", "target", "scale", "lam", "lo", "hi").agg(
        F.sum(F.col("n") * F.col("size") * rate).alias("got"),
        F.sum(F.when(F.col("lam") * x < bound, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
    )
    f = F.col("got") - F.col("target")
    lo, hi = F.when(f < 0, F.col("lam")).otherwise(F.col("lo")), F.when(f > 0, F.col("lam")).otherwise(F.col("hi"))
    step = F.col("lam") - F.try_divide(f, F.col("slope"))
    narrowed = sums.select("key", "target", "scale", "lam", lo.alias("lo"), hi.alias("hi"), step.alias("step"), (F.abs(f) / F.col("target")).alias("off"))
    inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
    wide = F.when(F.col("hi") > 1e5, F.greatest(2 * F.col("lam"), F.lit(1.0))).when(F.col("lo") < -1e5, F.least(2 * F.col("lam"), F.lit(-1.0)))
    moved = F.when(F.col("off") <= TOLERANCE, F.col("lam")).when(F.coalesce(inside, F.lit(False)), F.col("step")).otherwise(F.coalesce(wide, (F.col("lo") + F.col("hi")) / 2))
    return narrowed.select("key", "target", "scale", moved.alias("lam"), "lo", "hi", "off")


def tilt(cells: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """(key, lam, scale): the tilt of each source. A source at its cap or at zero needs none (lam null)."""
    scale = cells.groupBy("key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = goal.join(scale, "key").select("key", "target", "scale", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("off"))
    state = written(state.where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))), few=True)
    for _ in range(ROUNDS // STEPS):
        done = state
        for _ in range(STEPS):
            state = newton(cells, state, cap)
        state = written(state, few=True)
        drop_written(done)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("key", "lam", "scale")


def whole_copies(cells: DataFrame, cap: float) -> DataFrame:
    """cells (key, size, n, rate, target) plus k, the copies that its documents get together.

    Running sums of the rates, largest sizes first, are rounded; what a source is still off its
    target is then taken from or given to the largest size that fits, until none does.
    """
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", F.floor(upto + 0.5))
    k = F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))
    most = F.floor(F.lit(cap) * F.col("n"))
    cells = written(cells.withColumn("k", F.greatest(F.lit(0), F.least(k, most)).cast("long")).drop("upto"), few=True)
    while True:  # each round brings a source nearer to its target by a whole document at least, or ends
        off = cells.groupBy("key").agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("off"))
        room = F.when(F.col("off") > 0, most - F.col("k")).otherwise(F.col("k"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("off")) & (room > 0)
        both = cells.join(off, "key")
        best = written(both.where(fits).groupBy("key").agg(F.max("size").alias("size"), F.max("off").alias("off")), few=True)
        if best.isEmpty():
            break
        gain = F.least(room, F.floor(F.abs("off") / F.col("size"))) * F.signum("off")
        moved = cells.join(best, ["key", "size"], "left").withColumn("k", F.col("k") + F.when(F.col("off").isNull(), 0).otherwise(gain).cast("long"))
        done, cells = cells, written(moved.select(*cells.columns), few=True)
        drop_written(done)
        drop_written(best)
    return cells


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs plus size, source_size, target, rate, copies and taken (copies * size).

    Size counts the words of the text (null: 0). Which documents of a (source, size) cell
    get the extra copy follows from a hash of doc_id, so reruns agree. Ranks within a cell
    are taken in salted parts: a source or a group of copies with a third of the rows is
    dealt over many tasks. Null source: a source of its own, last. Documents without words have taken 0.
    Empty table: no rows. Columns of docs named like an output are replaced.
    """
    outputs = ["size", "source_size", "target", "rate", "copies", "taken"]
    names = [c for c in docs.columns if c not in outputs]
    tagged = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], source_key(F.col("source")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("size"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.col("doc_id").alias("order"),
    )
    counts = written(tagged.groupBy("key", "size", "salt").agg(F.count("*").alias("m")), few=True)
    cells = written(counts.groupBy("key", "size").agg(F.sum("m").alias("n")), few=True)
    goal = written(targets(cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), few=True)
    tilts = tilt(cells, goal, cap)
    full = F.when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    x = F.col("size") / F.col("scale")
    rated = cells.join(goal, "key").join(tilts, "key", "left").withColumn("rate", F.coalesce(F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap)))), full))
    solved = whole_copies(rated.select("key", "size", "n", "rate", "source_size", "target"), cap)
    before = F.sum("m").over(Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(solved, ["key", "size"]).drop("m")
    part = Window.partitionBy("key", "size", "salt").orderBy("order")
    ranked = tagged.join(starts, ["key", "size", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(part) - 1)
    copies = F.expr("k div n") + F.when(F.col("rank") < F.expr("k % n"), 1).otherwise(0)
    return ranked.withColumn("copies", copies).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies, with the columns of docs."""
    return mix(docs.select("*"), **options).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
