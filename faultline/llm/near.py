"""Near duplicates by SimHash fingerprints of 5-word shingle sets and trie self-joins; what these link is checked exactly by its shingles."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import drop_written, written
from .graph import components
from .tokens import in_parts

#: Words of a shingle; least similarity (intersection by union) of near duplicates, as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Nodes of a frequent shingle that all its nodes are checked against first; all pairs left in different components follow, so it decides nothing.
STARS = 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles; fewer words than a shingle are one as a whole, none give none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)] * bool(w)
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64))


def _name(blob: bytes) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(blob)
    return x - (1 << 64) if x >> 63 else x


def remixed(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def built(docs: DataFrame, columns, schema: str) -> DataFrame:
    """(doc_id, version, node, ...): node names the shingle set, version tells texts apart; columns makes the rest of a list of shingle sets."""

    def build(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in in_parts(texts):
                held = [shingles(t) for t in texts[lo:hi]]
                nodes = pa.array([_name(h.tobytes()) for h in held], pa.int64())
                made = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), nodes, *columns(held)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    names = ["doc_id", "version", "node", *(c.split()[0] for c in schema.split(", "))]
    rows = docs.select(F.col("doc_id").cast("long"), version_of("text").alias("version"), "text")
    return rows.mapInArrow(build, f"doc_id long, version long, node long, {schema}")


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, held): held are the hashes of the shingle set."""
    return built(docs, lambda held: [pa.array([h.tobytes() for h in held], pa.binary())], "held binary")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, fp, more): 128 bits of SimHash of the shingle set."""

    def bits(held):
        flat, lengths = np.concatenate(held), np.array([len(h) for h in held], np.int64)
        return [pa.array(simhash.majority_bits(h, lengths).view(np.int64)) for h in (flat, remixed(flat))]

    return built(docs, bits, "fp long, more long")


def version_of(text: str):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (src, dst) of nodes whose sets are similar enough, by their exact intersection."""

    def listed(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            for lo, hi in in_parts(blobs):
                ends = np.cumsum([0, *(len(x) // 8 for x in blobs[lo:hi])]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs[lo:hi]), np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), held], names=["node", "held"])

    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    of = written(found.select("node", "held").join(ends, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(listed, "node long, held array<long>"))
    both = pairs.join(of.select(F.col("node").alias("src"), F.col("held").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("held").alias("b")), "dst")
    common = F.size(F.array_intersect("a", "b"))
    good = written(both.where(SIMILAR[1] * common >= SIMILAR[0] * (F.size("a") + F.size("b") - common)).select("src", "dst"), few=True)
    drop_written(of)
    return good


def rare_ends(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root, n, at, shingle): of each node's shingles, rarest among the nodes first, those two similar sets must share one of.

    Sets of sizes n and m that are similar hold more than (n + m) * share shingles in common, share = S / (1 + S); in one order of
    all shingles their first common one is then among the first n - ceil(S * n) + 1 of either. at counts from 0.
    """
    num, den = SIMILAR
    of = found.select("node", "held").join(nodes, "node").dropDuplicates(["node"])
    whole = written(of.select("node", "root", "held"))

    def flat(batches):
        for batch in batches:
            for lo, hi in in_parts(batch.column(2).to_pylist()):
                part = batch.slice(lo, hi - lo)
                held = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                sizes = [len(x) for x in held]
                which = pa.array(np.repeat(np.arange(hi - lo), sizes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(held))], names=["node", "root", "n", "shingle"])

    spread = whole.mapInArrow(flat, "node long, root long, n long, shingle long")
    often = spread.groupBy("shingle").agg(F.count("*").alias("often"))
    shared = spread.join(often.where("often > 1"), "shingle")  # shingles of one node come before these
    node = Window.partitionBy("node")
    ranked = shared.withColumn("at", F.col("n").cast("int") - F.count("*").over(node).cast("int") + F.row_number().over(node.orderBy("often", "shingle")) - 1)
    ends = written(ranked.where(f"at < n - ceil(n * {num}D / {den} - 1e-9) + 1").select("node", "root", "n", "at", "shingle"))
    drop_written(whole)
    return ends


def rare_stars(ends: DataFrame) -> DataFrame:
    """(src, dst): in shingles of more than twice STARS nodes, each node with STARS of them (by hash) of other roots. Linear in the ends."""
    num, den = SIMILAR
    many = ends.groupBy("shingle").agg(F.count("*").alias("held")).where(f"held > {2 * STARS}").select("shingle")
    held = ends.join(many, "shingle", "left_semi")
    few = held.withColumn("k", F.row_number().over(Window.partitionBy("shingle").orderBy(F.xxhash64("node"), "node"))).where(f"k <= {STARS}")
    few = few.select("shingle", F.col("node").alias("star"), F.col("root").alias("s"), F.col("n").alias("m"))
    pairs = held.join(few, "shingle").where(f"root <> s AND least(n, m) * {den} >= greatest(n, m) * {num}")
    return pairs.select(F.least("node", "star").alias("src"), F.greatest("node", "star").alias("dst")).distinct()


def rare_pairs(ends: DataFrame) -> DataFrame:
    """(src, dst) for nodes of different roots that share a rare shingle and may be similar by sizes and places: from it on,
    enough are left in both. The first common shingle of a similar pair meets all this, so that no pair is missed.
    Of each shingle, nodes outside its most frequent root meet the others, so that nodes of one root are never held against each other."""
    num, den = SIMILAR
    roots = ends.groupBy("shingle", "root").agg(F.count("*").alias("held")).groupBy("shingle").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.count("*").alias("roots"))
    placed = ends.join(roots.where("roots > 1").drop("roots"), "shingle")
    x = placed.where("root <> main").select("shingle", F.col("node").alias("xv"), F.col("root").alias("xr"), F.col("n").alias("xn"), F.col("at").alias("xa"))
    y = placed.select("shingle", F.col("node").alias("yv"), F.col("root").alias("yr"), F.col("n").alias("yn"), F.col("at").alias("ya"), "main")
    once = "xr <> yr AND (yr = main OR xv < yv)"
    fits = f"least(xn, yn) * {den} >= greatest(xn, yn) * {num}"
    # the smaller side needs only its first n - ceil(2 * S / (1 + S) * n) + 1 shingles
    first = f"least(xn, yn) - ceil(least(xn, yn) * {2 * num}D / {num + den} - 1e-9) + 1"
    early = f"CASE WHEN xn < yn OR (xn = yn AND xv < yv) THEN xa ELSE ya END < {first}"
    places = f"(xn + yn) * {num}D / {num + den} - 1e-9 <= least(xn - xa, yn - ya)"
    return x.join(y, "shingle").where(f"{once} AND {fits} AND {early} AND {places}").select(F.least("xv", "yv").alias("src"), F.greatest("xv", "yv").alias("dst")).distinct()


def groups(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) for the nodes that are near another one; found are the fingerprints of docs.

    Tries over the fingerprints link what may be similar into loose groups; only texts of such groups are read again for their shingles.
    First each node is checked against the least node of its loose group, which settles dense groups at their size. Nodes of
    loose groups that hold several components are then held against a few nodes of each of their rarest shingles, which settles most of a
    group, and what is left in different components is paired by those shingles, which misses none; texts just below
    the similarity that differ in shingles of their own, however many a group holds, are not paired.
    """
    row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("row")
    nodes = written(found.groupBy("node", "fp", "more").agg(row))
    loose = simhash.wide_groups(nodes.select("fp", "more"))
    placed = written(nodes.join(loose, "fp", "left").select("node", "row", F.coalesce("loose", "fp").alias("loose")))
    least = written(placed.groupBy("loose").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("loose", "least"), few=True)
    members = written(placed.join(least, "loose"))
    own = docs.select(F.col("doc_id").cast("long"), "text", version_of("text").alias("version"))
    rows = members.select(F.col("row.doc_id").alias("row_id"), F.col("row.version").alias("row_version"))
    held = written(sets(own.join(rows, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("version") == F.col("row_version")), "left_semi")))
    first = similar(written(members.where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst")), few=True), held)
    roots = written(components(first), few=True)
    rooted = members.select("node", "loose").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("loose").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("loose")
    open_ = rooted.join(mixed, "loose", "left_semi").select("node", "root")
    ends = rare_ends(open_, held)
    linked = first.unionByName(similar(written(rare_stars(ends)), held))
    roots = written(components(linked), few=True)
    ends = written(ends.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return written(components(linked.unionByName(similar(written(rare_pairs(ends)), held))), few=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates (similarity of 5-word shingle sets of 0.8 or more, and chains of such pairs, as far as their SimHash
    fingerprints meet in a trie).

    Of each group the row with the smallest doc_id stays, rows without one last, then by text hash. Rows that repeat
    a doc_id with other texts are rows of their own; rows that repeat doc_id and text are one. Texts without a word (null ones too) are
    copies of each other: one stays. Other columns are kept as they are. Empty table: no rows.
    """
    found = written(fingerprints(docs))
    rooted = found.select("doc_id", "version", "node").join(groups(found, docs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("kept")
    kept = rooted.groupBy("root").agg(first).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.version").alias("kept_version"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("own_id"), version_of("text").alias("version"))
    stay = own.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version")), "left_semi")
    return stay.dropDuplicates(["own_id", "version"]).select("all.*")
