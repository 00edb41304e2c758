"""Prefix trie of conversations: sorted sequences, common prefixes of neighbours, range minima in sparse tables.

Sequences of turns are sorted as strings of turn digests, copies by conversation. A trie node is a run of this order whose
neighbours share enough turns, so every prefix finds its members alone: it searches the sparse table of the common prefix
lengths to the left and to the right until a length falls below its depth. No stack is walked and no prefix waits for another.

The order is cut into blocks of a bounded size. A task has the table of one block; a second, broadcast table has one entry a
block. A search that leaves its block finds the block where it ends in the second table, and the place inside from the few
depths at which that block can be entered (its stairs).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, shuffle_width, written

#: Sequences and turns of a block; most blocks, beyond which blocks get longer (the broadcast table has this many entries at most).
BLOCK_ROWS, BLOCK_TURNS, MOST_BLOCKS = 4096, 1 << 18, 1 << 20
#: Bytes of a turn's digest.
WIDTH = 16
_NONE = np.iinfo(np.int64).max
_NODE = "l long, depth int, conv_id long, parent_conv_id long, n_convs long, n_leaves long, saved_tokens long, n_children long, ends_sha256 string, chunk long, ids string"
_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_STAIR = "side int, depth int, at int, conv long, leaf long, a long, b long, lcp int"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, size>>) of conversations (conv_id, turn, role, text), by turn, null first.

    Null role or text count as empty. Turns of the same number follow by digest, repeated rows are turns of their own.
    Rows without conv_id belong to no conversation and are left out. A conversation is held by one task as 40 bytes a turn.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.sha2(F.coalesce("role", F.lit("")), 256), text), 256), 1, 2 * WIDTH)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Digests that two sequences share from their start."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    if a[: hi * WIDTH] == b[: hi * WIDTH]:
        return hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo * WIDTH : mid * WIDTH] == b[lo * WIDTH : mid * WIDTH] else (lo, mid)
    return lo


class Table:
    """Range minima of an array: level k has the minimum of 2**k entries from each place on."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << len(self.levels) - 1 <= self.n:
            t, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(t[:-step], t[step:]))

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from start on with a value below least, or n."""
        at = np.array(start, np.int64)
        for k in reversed(range(len(self.levels))):
            fits = at + (1 << k) <= self.n
            at += (fits & (self.levels[k][np.where(fits, at, 0)] >= least)).astype(np.int64) << k
        return at

    def left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place up to start with a value below least, or -1."""
        at = np.array(start, np.int64)
        for k in reversed(range(len(self.levels))):
            fits = at + 1 >= 1 << k
            at -= (fits & (self.levels[k][np.where(fits, at + 1 - (1 << k), 0)] >= least)).astype(np.int64) << k
        return at

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of places lo to hi, of none the largest long."""
        size = hi - lo + 1
        out = np.full(len(lo), _NONE, np.int64)
        level = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
        for k in np.unique(level[level >= 0]):
            w = level == k
            out[w] = np.minimum(self.levels[k][lo[w]], self.levels[k][hi[w] - (1 << int(k)) + 1])
        return out


class Sums:
    """Sums over places lo to hi (lo = hi + 1: none)."""

    def __init__(self, values: np.ndarray):
        self.upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.upto[hi + 1] - self.upto[lo]


class Block:
    """The sequences of one block, in order. first, after: turns shared by its first sequence with the one before, and by the next block's first with its last (-1: none)."""

    def __init__(self, rows: pd.DataFrame, first: int, after: int):
        rows = rows.sort_values("at")
        self.conv = rows["conv_id"].to_numpy(np.int64)
        self.lcp = rows["lcp"].to_numpy(np.float64)
        self.lcp[0] = first
        self.lcp = self.lcp.astype(np.int64)
        sizes = [np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in rows["sizes"]]
        self.length = np.fromiter(map(len, sizes), np.int64, len(sizes)) - 1
        self.begins = np.concatenate([[0], np.cumsum(self.length + 1)[:-1]])
        self.sizes = np.concatenate(sizes)
        self.n, self.first, self.after = len(rows), first, after
        all_, shared = self.upto(np.arange(self.n), self.length), self.upto(np.arange(self.n), np.maximum(self.lcp, 0))
        leaf = np.append(self.lcp[1:], after) < self.length
        self.table, self.convs = Table(self.lcp), Table(self.conv)
        #: Childless nodes; code points of whole sequences; those of the turns that the sequence before does not share.
        self.leaf, self.a, self.b = Sums(leaf), Sums(all_), Sums(all_ - shared)

    def upto(self, p: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Code points of the first d turns of sequence p."""
        return self.sizes[self.begins[p] + d]

    def measures(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        return {"conv": self.convs.least(lo, hi), "leaf": self.leaf.over(lo, hi), "a": self.a.over(lo, hi), "b": self.b.over(lo, hi)}

    def summary(self) -> dict:
        """Measures of the whole block, and its stairs: for each depth at which a search may end here, entering from either side, where and what it covers."""
        low, m = int(self.lcp.min()), self.n
        whole = {k: int(v[0]) for k, v in self.measures(np.array([0]), np.array([m - 1])).items()}
        stairs = []
        for side, top in ((0, self.after), (1, self.first)):
            d = np.arange(low + 1, top + 1)
            at = self.table.right(np.zeros(len(d)), d) if side else self.table.left(np.full(len(d), m - 1), d)
            got = self.measures(np.zeros(len(d), np.int64), at - 1) if side else self.measures(at, np.full(len(d), m - 1))
            lcp = np.zeros(len(d), np.int64) if side else self.lcp[at]
            stairs += [dict(zip(("side", "depth", "at", *got, "lcp"), x)) for x in zip([side] * len(d), d.tolist(), at.tolist(), *(v.tolist() for v in got.values()), lcp.tolist())]
        return {"n": m, "low": low} | whole | {"stairs": stairs}

    def extents(self, p: np.ndarray, d: np.ndarray, start: int, ends: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """Members of the prefixes of d turns of sequences p: places l to r of the whole order and their measures. ends: what the searches find beyond the block, by side and depth."""
        lo, hi = self.table.left(p, d), self.table.right(p + 1, d) - 1
        out = self.measures(np.maximum(lo, 0), hi)
        out |= {"l": start + np.maximum(lo, 0), "r": start + hi, "lcp": self.lcp[np.maximum(lo, 0)]}
        for side, over in ((0, lo < 0), (1, (hi == self.n - 1) & (d <= self.after))):
            if over.any():
                far = {k: v[d[over]] for k, v in ends[side].items()}
                out["r" if side else "l"][over] = far["pos"]
                out["conv"][over] = np.minimum(out["conv"][over], far["conv"])
                for k in ("leaf", "a", "b"):
                    out[k][over] += far[k]
                if not side:
                    out["lcp"][over] = far["lcp"]
        return out


class Blocks:
    """The second table: one entry a block, in order."""

    def __init__(self, rows: list, first: dict[int, int]):
        rows = sorted(rows)
        column = lambda k: np.array([r[k] for r in rows], np.int64)
        self.ids, self.low, self.convs = column(0), Table(column(2)), Table(column(3))
        self.start = np.concatenate([[0], np.cumsum(column(1))])
        self.first = np.array([*(first[i] for i in self.ids.tolist()), -1], np.int64)
        self.leaf, self.a, self.b = Sums(column(4)), Sums(column(5)), Sums(column(6))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        return {"conv": self.convs.least(lo, hi), "leaf": self.leaf.over(lo, hi), "a": self.a.over(lo, hi), "b": self.b.over(lo, hi)}

    def searches(self, i: int) -> pd.DataFrame:
        """All searches that may leave block i: the block where each ends (-1: at an edge, with its place) and the measures of the blocks between."""
        frames = []
        d = np.arange(self.first[i] + 1)
        to = self.low.left(np.full(len(d), i - 1), d)
        frames.append({"side": np.zeros(len(d), np.int64), "depth": d, "target": self.ids[to], "pos": self.start[to]} | self.between(to + 1, np.full(len(d), i - 1)))
        d = np.arange(self.first[i + 1] + 1)
        to = self.low.right(np.full(len(d), i + 1), d)
        inside = self.first[to] >= d
        frames.append({"side": np.ones(len(d), np.int64), "depth": d, "target": np.where(inside, self.ids[np.minimum(to, len(self.ids) - 1)], -1), "pos": self.start[to] - 1} | self.between(np.full(len(d), i + 1), to - 1))
        return pd.concat([pd.DataFrame(f) for f in frames], ignore_index=True).assign(block=self.ids[i])


def ordered(seqs: DataFrame, block_rows: int) -> DataFrame:
    """Sequences in order, with the turns shared with the one before (null at the start of a partition): (block, at, conv_id, lcp, sizes, edge)."""

    def scan(batches):
        before, block, at, turns, out, edge = None, 0, 0, 0, [], None

        def cut(rows):
            columns = list(zip(*rows)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["block", "at", "conv_id", "lcp", "sizes", "edge"])

        for batch in batches:
            for part, conv, key, sizes in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if before is None:
                    block, lcp, edge = part << 32, None, key
                else:
                    lcp = common(before, key)
                    if at == block_rows or turns >= BLOCK_TURNS:
                        block, at, turns = block + 1, 0, 0
                if len(out) >= 2048 or out and turns == 0:
                    yield cut(out)
                    out = []
                out.append([block, at, conv, lcp, sizes, edge])
                before, edge, at, turns = key, None, at + 1, turns + len(sizes)
        if out:
            out[-1][5] = before
            yield cut(out)

    keyed = seqs.repartitionByRange(shuffle_width(seqs.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return keyed.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "key", "sizes").mapInArrow(scan, "block long, at int, conv_id long, lcp int, sizes array<long>, edge binary")


def first_shared(order: DataFrame) -> dict[int, int]:
    """Turns that each block's first sequence shares with the one before it (-1: none is before); compares two keys a partition."""

    def meet(batches):
        before = None
        for pdf in batches:
            found = []
            for block, lcp, edge in zip(pdf["block"], pdf["lcp"], pdf["edge"]):
                if pd.isna(lcp):
                    found.append((block, -1 if before is None else common(before, edge)))
                before = edge
            yield pd.DataFrame(found, columns=["block", "lcp"])

    edges = order.where("edge is not null").select("block", "at", "lcp", "edge").coalesce(1).sortWithinPartitions("block", "at").select("block", "lcp", "edge")
    inner = order.where("at = 0 and lcp is not null").select("block", "lcp")
    return {r[0]: r[1] for r in edges.mapInPandas(meet, "block long, lcp int").unionByName(inner).collect()}


def prefix_trie(seqs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns) as sequences() gives them, from the empty one on.

    conv_id: smallest member; depth; parent_conv_id: the parent's (null for the empty prefix); n_convs: members; n_children;
    n_leaves: childless nodes at or below it; saved_tokens: over the nodes at or below it, (n_convs - 1) times the code points
    of the last turn; ends_sha256: SHA-256 of the members of exactly this length, ascending, comma-joined. Sequences without
    turns are members of the empty prefix only; without sequences there are no rows. A conv_id on several rows counts each time.
    """
    spark = seqs.sparkSession
    flat = written(seqs.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.size").alias("sizes")))
    if not (n := flat.count()):
        return spark.createDataFrame([], _RESULT)
    order = written(ordered(flat, max(block_rows, -(-n // MOST_BLOCKS))))
    first = first_shared(order)
    ids = sorted(first)
    after = spark.sparkContext.broadcast({i: (first[i], first[j]) for i, j in zip(ids, [*ids[1:], None]) if j is not None} | {ids[-1]: (first[ids[-1]], -1)})
    rows = order.select("block", "at", "conv_id", "lcp", "sizes")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["block"].iloc[0])
        return pd.DataFrame([{"block": i} | Block(pdf, *after.value[i]).summary()])

    sums = written(rows.groupBy("block").applyInPandas(summarise, f"block long, n long, low int, conv long, leaf long, a long, b long, stairs array<struct<{_STAIR.replace(' ', ':').replace(',:', ',')}>>"), few=True)
    blocks = spark.sparkContext.broadcast(Blocks([tuple(r) for r in sums.select("block", "n", "low", "conv", "leaf", "a", "b").collect()], first))

    def leave(batches):
        for pdf in batches:
            for i in np.searchsorted(blocks.value.ids, pdf["block"].to_numpy()).tolist():
                yield blocks.value.searches(i)

    asked = sums.select("block").mapInPandas(leave, "block long, side int, depth int, target long, pos long, conv long, leaf long, a long, b long")
    stairs = sums.select(F.col("block").alias("target"), F.explode("stairs").alias("s")).select("target", F.col("s.side").alias("side"), F.col("s.depth").alias("depth"), "s")
    plus = lambda c: (F.col(c) + F.coalesce(F.col(f"s.{c}"), F.lit(0))).alias(c)
    answers = asked.join(stairs, ["target", "side", "depth"], "left").select(
        "block", "side", "depth", (F.col("pos") + F.coalesce("s.at", F.lit(0))).alias("pos"), F.least("conv", "s.conv").alias("conv"), plus("leaf"), plus("a"), plus("b"), F.coalesce("s.lcp", F.lit(0)).alias("lcp")
    )

    def nodes(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["block"].iloc[0])
        block, start = Block(pdf, *after.value[i]), int(blocks.value.start[np.searchsorted(blocks.value.ids, i)])
        ends = {side: {c: g.sort_values("depth")[c].to_numpy(np.int64) for c in ("pos", "conv", "leaf", "a", "b", "lcp")} for side, g in found.groupby("side")}
        return tabulate(block, start, ends)

    out = written(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(nodes, _NODE))
    chunks = out.where("chunk is not null").select("l", "depth", "chunk", "ids").repartition(shuffle_width(spark), "l", "depth").sortWithinPartitions("l", "depth", "chunk")
    digests = chunks.mapInPandas(digested, "l long, depth int, ends_sha256 string")
    whole = out.where("chunk is null").drop("chunk", "ids").unionByName(digests, allowMissingColumns=True)
    most = [F.max(c).alias(c) for c in ("conv_id", "parent_conv_id", "n_convs", "n_leaves", "saved_tokens", "ends_sha256")]
    nodes_ = whole.groupBy("l", "depth").agg(*most, F.sum("n_children").alias("n_children"))
    for done in (flat, order, sums):
        drop_written(done)
    return nodes_.select(
        "conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def tabulate(block: Block, start: int, ends: dict) -> pd.DataFrame:
    """The nodes that begin in a block, one row each; one row for each parent, with the children that begin here; and the ids of runs of copies that may leave the block."""
    p = np.repeat(np.arange(block.n), block.length - block.lcp)
    d = block.lcp[p] + 1 + np.arange(len(p)) - np.repeat(np.cumsum(block.length - block.lcp) - (block.length - block.lcp), block.length - block.lcp)
    found = block.extents(p, d, start, ends)
    n = found["r"] - found["l"] + 1
    own, least = block.upto(p, np.maximum(d - 1, 0)), block.upto(p, np.maximum(np.minimum(found["lcp"], d), 0))
    saved = found["a"] - n * own - (found["b"] + least - own)
    parent = np.full(len(p), _NONE, np.int64)
    parent[1:] = found["conv"][:-1]  # of a node below the first that its sequence begins
    top = np.flatnonzero((d == block.lcp[p] + 1) & (d > 0))
    above = block.extents(p[top], d[top] - 1, start, ends)
    parent[top] = above["conv"]
    frame = pd.DataFrame({"l": found["l"], "depth": d, "conv_id": found["conv"], "parent_conv_id": pd.array(parent, "Int64"), "n_convs": n, "n_leaves": found["leaf"], "saved_tokens": saved, "n_children": (d < block.length[p]).astype(np.int64)})
    frame.loc[d == 0, "parent_conv_id"] = pd.NA
    kids = pd.DataFrame({"l": above["l"], "depth": d[top] - 1}).groupby(["l", "depth"], as_index=False).size().rename(columns={"size": "n_children"})
    frame["ends_sha256"] = None
    copies = block.lcp == block.length  # the same turns as the sequence before
    runs = np.flatnonzero(~copies | (np.arange(block.n) == 0))
    bottom = dict(zip(p[d == block.length[p]].tolist(), np.flatnonzero(d == block.length[p]).tolist()))
    chunks, digests = [], {}
    for lo, hi in zip(runs.tolist(), [*runs[1:].tolist(), block.n]):
        listed = ",".join(map(str, block.conv[lo:hi].tolist()))
        if copies[lo] or hi == block.n and block.after == block.length[lo]:
            at = block.extents(np.array([lo]), block.length[lo : lo + 1], start, ends)["l"][0]
            chunks.append((int(at), int(block.length[lo]), start + lo, listed))
        else:
            digests[bottom[lo]] = hashlib.sha256(listed.encode()).hexdigest()
    frame["ends_sha256"] = pd.Series(digests, dtype=object).reindex(frame.index)
    rest = pd.DataFrame(chunks, columns=["l", "depth", "chunk", "ids"])
    names = [c.split()[0] for c in _NODE.split(", ")]
    whole = [f.reindex(columns=names).astype(object) for f in (frame, kids, rest) if len(f)]
    whole = pd.concat(whole, ignore_index=True) if whole else frame.reindex(columns=names)
    for c in names:
        whole[c] = whole[c].astype("Int64") if c not in ("ends_sha256", "ids") else whole[c].where(whole[c].notna(), None)
    return whole


def digested(batches):
    """SHA-256 of the comma-joined ids of each node, whose chunks come in order; holds one chunk at a time."""
    node, state = None, None
    for pdf in batches:
        done = []
        for l, depth, ids in zip(pdf["l"].tolist(), pdf["depth"].tolist(), pdf["ids"].tolist()):
            if (l, depth) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (l, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["l", "depth", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["l", "depth", "ends_sha256"])
