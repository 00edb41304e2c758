"""Shards of near-equal bytes by histogram sort, all in DataFrame operations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Off by less than this share of a shard, a splitter is settled; a group of equal texts is cut only beyond the second.
TOLERANCE, GROUP_TOLERANCE = 0.002, 0.05
#: Candidate boundaries for each open splitter and round.
PROBES = 7
#: Bits of the text hash that part the rows for numbering; a group with more rows than one such part is parted by PART_BITS of its doc_ids' hash.
RANGE_BITS, PART_BITS = 12, 8


def counted(hist: DataFrame, probes: list[tuple], keys: list[str]) -> list[tuple[int, int]]:
    """Exact bytes and keys strictly below each of the sorted probes (tuples over the keys): one pass, one row per gap to the driver."""
    rows = hist.groupBy(below(probes, [F.col(k) for k in keys]).alias("gap")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    per = {r["gap"]: (r["bytes"], r["n"]) for r in rows}
    out, total, n = [], 0, 0
    for i in range(len(probes)):
        more = per.get(i, (0, 0))
        total, n = total + more[0], n + more[1]
        out.append((total, n))
    return out


def below(probes: list[tuple], cols: list[Column]) -> Column:
    """Number of the sorted probes that are <= the row, compared key by key: a balanced tree of comparisons."""

    def reached(probe: tuple) -> Column:
        test = cols[-1] >= F.lit(probe[-1])
        for c, p in zip(cols[-2::-1], probe[-2::-1]):
            test = (c > F.lit(p)) | ((c == F.lit(p)) & test)
        return test

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(reached(probes[mid]), node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(probes))


def refine(hist: DataFrame, goals: dict[int, int], brackets: dict[int, tuple[int, int]], prefix: dict[int, tuple], keys: list[str], allowed: float) -> dict[int, tuple]:
    """For each goal (bytes below it): (boundary, bytes below, keys below), searched within its bracket of the last key.

    Every round places PROBES boundaries in each open bracket, counts the bytes below all of them in one
    pass and keeps the gap around the goal; a splitter closes when it is within ``allowed`` bytes or
    its bracket holds a single key, where the nearer end counts. ``brackets`` gets the last gaps.
    """
    best: dict[int, tuple] = {}
    open_ = dict(brackets)
    while open_:
        probes = sorted({(*prefix[j], lo + (hi - lo) * (i + 1) // (PROBES + 1)) for j, (lo, hi) in open_.items() for i in range(-1, PROBES + 1)})
        got = dict(zip(probes, counted(hist, probes, keys)))
        for j, (lo, hi) in list(open_.items()):
            mine = [(p[-1], *got[p]) for p in probes if p[:-1] == prefix[j] and lo <= p[-1] <= hi]
            near = min(mine, key=lambda x: (abs(x[1] - goals[j]), x[0]))
            if j not in best or abs(near[1] - goals[j]) < abs(best[j][1] - goals[j]):
                best[j] = near
            left = max((x for x in mine if x[1] <= goals[j]), default=mine[0])
            right = min((x for x in mine if x[1] >= goals[j] and x[0] >= left[0]), default=mine[-1])
            brackets[j] = open_[j] = (left[0], right[0])
            if abs(best[j][1] - goals[j]) <= allowed or right[0] - left[0] <= 1 or right[2] - left[2] <= 1:
                del open_[j]
    return best


def shard(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> DataFrame:
    """docs plus size, shard (0 to shards - 1) and slot (gapless from 0): the law is near-equal bytes.

    Rows are ordered by the hash of their text, then doc_id, so equal texts are neighbours
    and share a shard unless their group lies across a boundary that cannot be met otherwise
    (a group with more than ``group_tolerance`` of a shard there is cut between its
    doc_ids). Splitters come from repeated exact counts of bytes; the rows then move once. Size: UTF-8
    bytes plus 8 (null text: 8). Null doc_id comes first within its group; rows equal in
    text and doc_id stay together. Slots follow the order, but for groups of many copies, which come last
    of their range of hashes. Empty table: no rows. Columns named like an output are replaced.
    """
    outputs = ["size", "shard", "slot"]
    names = [c for c in docs.columns if c not in outputs]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)],
        size.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"),
    )
    hist = written(keyed.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, rows = hist.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = total / shards
    goals = {j: round(total * j / shards) for j in range(1, shards)}
    splitters: list[tuple[int, int]] = []
    if total:
        brackets = {j: (LOW, HIGH) for j in goals}
        got = refine(hist, goals, brackets, dict.fromkeys(goals, ()), ["h"], tolerance * each)
        coarse = {j: g for j, g in goals.items() if abs(got[j][1] - g) > group_tolerance * each}
        final = {j: (got[j][0], LOW) for j in goals if j not in coarse}
        if coarse:  # each bracket holds one large group, which is cut by doc_id
            within = [(F.col("h") >= lo) & (F.col("h") < hi) for lo, hi in {brackets[j] for j in coarse}]
            held = [r["h"] for r in hist.where(functools.reduce(Column.__or__, within)).select("h").collect()]
            group = {j: next(h for h in held if brackets[j][0] <= h < brackets[j][1]) for j in coarse}
            first = sorted({(h,) for h in group.values()})
            outer = {h: got[0] for (h,), got in zip(first, counted(hist, first, ["h"]))}
            inner = written(keyed.where(F.col("h").isin(*outer)).groupBy("h", "d").agg(F.sum("size").alias("bytes")))
            offset = {h: got[0] for (h,), got in zip(first, counted(inner, [(h, LOW) for (h,) in first], ["h", "d"]))}
            shifted = {j: g - outer[group[j]] + offset[group[j]] for j, g in coarse.items()}
            cut = refine(inner, shifted, {j: (LOW, HIGH) for j in coarse}, {j: (group[j],) for j in coarse}, ["h", "d"], tolerance * each)
            final |= {j: (group[j], cut[j][0]) for j in coarse}
        splitters = sorted(final.values())
    placed = keyed.withColumn("shard", below(splitters, [F.col("h"), F.col("d")]).cast("int") if splitters else F.lit(0))
    return numbered(placed, hist, rows).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], *outputs)


def numbered(placed: DataFrame, hist: DataFrame, rows: int) -> DataFrame:
    """placed plus slot, gapless from 0 within each shard, without a task for a whole shard.

    Rows are numbered within parts (a range of text hashes; of a group with more rows than a range should have, a range of its
    doc_ids' hashes) and the parts' places are running sums of their counts. Of such groups there are fewer than ranges, which
    bounds what the driver sees; of parts there are at most that many times 2^PART_BITS, and the shards.
    """
    many = [r["h"] for r in hist.where(F.col("n") > F.lit(max(1, rows >> RANGE_BITS))).where("n > 1").select("h").collect()]
    wide = F.when(F.col("h").isin(many), F.col("h")) if many else F.lit(None).cast("long")
    part = F.when(F.col("h").isin(many), F.shiftrightunsigned(F.xxhash64("d"), 64 - PART_BITS)) if many else F.lit(None).cast("long")
    parted = placed.withColumns({"range": F.shiftright("h", 64 - RANGE_BITS), "wide": wide, "part": part})
    keys = ["range", "wide", "part"]
    sizes = parted.groupBy("shard", *keys).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(*keys)) - F.col("n")
    starts = sizes.select(F.col("shard").alias("s"), *[F.col(k).alias(f"start_{k}") for k in keys], before.alias("before"))
    own = parted.withColumn("place", F.row_number().over(Window.partitionBy("shard", *keys).orderBy("h", "d")))
    same = [F.col(k).eqNullSafe(F.col(f"start_{k}")) for k in keys]
    return own.join(starts, functools.reduce(Column.__and__, same, F.col("shard") == F.col("s"))).withColumn("slot", F.col("before") + F.col("place") - 1)
