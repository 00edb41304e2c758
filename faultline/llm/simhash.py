"""Near-duplicate groups by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, written
from .graph import components
from .tokens import in_parts

#: Least leading bits that deal trie nodes to tasks. A fingerprint goes to 1 + b + b(b-1)/2 node pairs (56 for 10).
PREFIX_BITS = 10
#: Fingerprints of a trie node, on average, above which the prefix is lengthened.
NODE_ROWS = 1 << 20
#: Fingerprint copies that a task traverses at once.
TRAVERSE_ROWS = 400_000

#: Wide budgets: most differing bits of the first 64 and of all 128 bits, rows of a trie node on average, and the
#: logarithm of how rarely a pair of word sets of similarity 0.8 (0.15 of its bits differ) may meet in no trie.
WIDE, WIDE_ROWS, SURE, ALIKE = (22, 33), 128, 8, 0.85
#: Rows of a node above which its rows are first held against PIVOTS of them; pairs descended or compared at once.
DENSE, PIVOTS, PAIRS = 1000, 64, 1_000_000

_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``lengths`` hashes: a bit is 1 if set in over half of them; empty runs give 0."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    parts = -(-n // 255)  # byte lanes hold sums of at most 255 hashes
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    at = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    bits = np.zeros((len(full), 64), np.uint8)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        bits[:, k::8] = 2 * np.add.reduceat(sums.astype(np.int64), first, axis=0) > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, version): SimHash over the lower-cased word shingles (XXH64, seed 42), repeats included.

    Fewer words than a shingle: the whole sequence is the shingle; null or blank text: 0. version, a hash of the text, tells
    rows of one doc_id apart.
    """

    def hashed(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts, out = batch.column(1).to_pylist(), [np.zeros(0, np.uint64)]
            for lo, hi in in_parts(texts):
                runs, lengths = [], []
                for text in texts[lo:hi]:
                    w = (text or "").encode().lower().split()
                    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)] * bool(w)
                    h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64)
                    runs.append(h)
                    lengths.append(len(h))
                out.append(majority_bits(np.concatenate(runs), np.array(lengths, np.int64)))
            fp = pa.array(np.concatenate(out).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, batch.column(2)], names=["doc_id", "fp", "version"])

    version = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), "text", version.alias("version")).mapInArrow(hashed, "doc_id long, fp long, version long")


def trie_pairs(keys: np.ndarray, left: tuple, right: tuple, spent: np.ndarray, budget: int, top: int = 63, few: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` (uint64, sorted within each node) of the pairs below the given node pairs.

    left, right: (start, end) arrays of the two nodes; spent: bits by which their prefixes
    differ; top: the highest bit below the nodes. Pairs descend together one bit at a time; a pair goes when its differing
    bits exceed the budget, and is settled by comparisons when its nodes hold at most ``few`` pairs of keys.
    A node paired with itself gives each pair of its keys once.
    """
    (al, ah), (bl, bh), d = left, right, spent
    found_a, found_b = [], []
    for bit in range(top, -2, -1):
        if bit >= 0:
            lone = (ah - al) * (bh - bl) <= few
        else:
            lone = np.ones(len(al), bool)  # all bits are used: equal keys, or the budget held
        if lone.any():
            a, b = al[lone], bl[lone]
            if few > 1:
                wide, pairs = bh[lone] - b, (ah[lone] - a) * (bh[lone] - b)
                own, wide, a, b = (np.repeat(v, pairs) for v in (a == b, wide, a, b))
                at = np.arange(len(a)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                a, b = a + at // wide, b + at % wide
                a, b = a[~own | (a < b)], b[~own | (a < b)]
            near = (np.bitwise_count(keys[a] ^ keys[b]) <= budget) & (a != b)
            found_a.append(a[near])
            found_b.append(b[near])
            al, ah, bl, bh, d = (x[~lone] for x in (al, ah, bl, bh, d))
        if not len(al):
            break
        zeros = np.concatenate([[0], np.cumsum(((keys >> np.uint64(bit)) & np.uint64(1)) == 0)])
        am, bm = al + zeros[ah] - zeros[al], bl + zeros[bh] - zeros[bl]
        own = al == bl
        steps = (
            (al, am, bl, bm, d, None), (am, ah, bm, bh, d, None),
            (al, am, bm, bh, d + 1, None), (am, ah, bl, bm, d + 1, ~own),
        )
        grown = []
        for x0, x1, y0, y1, cost, only in steps:
            ok = (x1 > x0) & (y1 > y0) & (cost <= budget)
            if only is not None:
                ok &= only
            ok &= ~((x0 == y0) & (x1 - x0 == 1))  # a single key with itself
            grown.append([v[ok] for v in (x0, x1, y0, y1, cost)])
        al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*grown))
    none = np.zeros(0, np.int64)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with node != root, spanning the components of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def near_links(fps: DataFrame, budget: int = 2, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(src, dst): a spanning set of the links between distinct fingerprints (column fp) within ``budget`` bits.

    Each fingerprint goes to every pair of trie nodes at depth ``prefix_bits`` whose
    prefixes are within the budget; tasks traverse their node pairs and return, of each
    piece of work, the links of a spanning forest, so that a dense group costs its size.
    """
    depth = prefix_bits
    masks = [m for m in range(1 << depth) if m.bit_count() <= budget]
    own = F.shiftrightunsigned("fp", 64 - depth).cast("int")
    dealt = fps.select("fp", own.alias("p"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(
        F.least("p", F.col("p").bitwiseXOR(F.col("mask"))).alias("p"), F.greatest("p", F.col("p").bitwiseXOR(F.col("mask"))).alias("q"), "fp"
    )

    def traverse(batches):
        """Rows of one node pair are adjacent; whole pairs are gathered up to TRAVERSE_ROWS."""
        held: list[np.ndarray] = []
        size = 0

        def solve(block: np.ndarray, key: np.ndarray):
            fp = block.astype(np.int64).view(np.uint64)
            side = (fp >> np.uint64(64 - depth)).astype(np.int64)
            order = np.lexsort((fp, side, key))
            fp, side, key = fp[order], side[order], key[order]
            node = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])]))
            ends = np.append(node[1:], len(fp))
            k, s = key[node], side[node]
            p, q = k >> depth, k & ((1 << depth) - 1)
            alone = np.flatnonzero(p == q)
            two = np.flatnonzero((k[1:] == k[:-1])) if len(k) > 1 else np.zeros(0, np.int64)
            left, right = np.concatenate([alone, two]), np.concatenate([alone, two + 1])
            spent = np.bitwise_count(s[left] ^ s[right]).astype(np.int64)
            a, b = trie_pairs(fp, (node[left], ends[left]), (node[right], ends[right]), spent, budget, 63 - depth)
            x, y = forest(fp[a].view(np.int64), fp[b].view(np.int64)) if len(a) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["src", "dst"])

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << depth | batch.column(1).to_numpy().astype(np.int64)
            held.append(np.stack([batch.column(2).to_numpy(), key]))
            size += len(key)
            if size >= TRAVERSE_ROWS and held[0][1][0] != key[-1]:
                rows = np.concatenate(held, axis=1)
                cut = np.flatnonzero(rows[1][1:] != rows[1][:-1])[-1] + 1
                yield solve(rows[0][:cut], rows[1][:cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            rows = np.concatenate(held, axis=1)
            yield solve(rows[0], rows[1])

    spread = dealt.repartition("p", "q").sortWithinPartitions("p", "q")
    return spread.mapInArrow(traverse, "src long, dst long")


def dense_links(x: np.ndarray, y: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that span the pairs of (x, y) within the budget. A dense group is settled by a few pivots, at its size; every row outside
    the largest group then meets all rows."""
    n = len(x)

    def met(rows: np.ndarray):
        a, b = np.nonzero(np.bitwise_count(x[rows, None] ^ x) + np.bitwise_count(y[rows, None] ^ y) <= budget)
        return rows[a], b

    def grown(links: tuple, rows: np.ndarray) -> tuple:
        step = max(1, PAIRS // n)
        for lo in range(0, len(rows), step):
            links = forest(*(np.concatenate(c) for c in zip(links, met(rows[lo : lo + step]))))
        return links

    links = grown((np.zeros(0, np.int64),) * 2, np.unique(np.linspace(0, n - 1, PIVOTS).astype(np.int64)))
    label = np.arange(n)
    label[links[0]] = links[1]
    return grown(links, np.flatnonzero(label != np.bincount(label).argmax()))


def wide_links(fps: DataFrame) -> DataFrame:
    """(src, dst): links that span nearly all pairs of distinct fp whose 128 bits (fp, more) are within the wide budget.

    No single trie prunes at a budget of a quarter of the bits, so each of many tries takes the bits in an order of its own, and only
    pairs that share its first bits descend in it, bit by bit. The depth grows with the logarithm of the rows, so that a node keeps
    its size, and the tries with it, so that a pair of similarity 0.8 meets in one of them but for exp(-SURE).
    """
    depth = max(4, (fps.count() // WIDE_ROWS).bit_length())
    tries = math.ceil(SURE / ALIKE**depth)
    orders = [np.random.default_rng(t).permutation(128)[:depth] for t in range(tries)]

    def deal(batches):
        for batch in batches:
            bits = [batch.column(i).to_numpy().view(np.uint64) for i in range(2)]
            for t, order in enumerate(orders):
                node = np.full(len(bits[0]), t << depth, np.int64)
                for i, b in enumerate(order.tolist()):
                    node |= ((bits[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << i
                yield pa.RecordBatch.from_arrays([pa.array(node), batch.column(0), batch.column(1)], names=["node", "fp", "more"])

    def solve(node: np.ndarray, fp: np.ndarray, more: np.ndarray):
        """Links among the rows of whole nodes."""
        order = np.lexsort((fp, node))
        node, fp, more = node[order], fp[order], more[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(start, len(node)))
        found = []
        for at, n in zip(start[size > DENSE].tolist(), size[size > DENSE].tolist()):
            a, b = dense_links(fp[at : at + n], more[at : at + n], WIDE[1])
            found.append((at + a, at + b))
        some = (size > 1) & (size <= DENSE)
        start, size = start[some], size[some]
        part = np.cumsum(size**2) // PAIRS
        for run in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
            if len(run):
                lo, hi = start[run[0]], start[run[-1]] + size[run[-1]]
                ends = start[run] - lo, start[run] - lo + size[run]
                a, b = trie_pairs(fp[lo:hi], ends, ends, np.zeros(len(run), np.int64), WIDE[0], few=64)
                a, b = a + lo, b + lo
                near = np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(more[a] ^ more[b]) <= WIDE[1]
                found.append((a[near], b[near]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        x, y = forest(fp[a].view(np.int64), fp[b].view(np.int64)) if len(a) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["src", "dst"])

    def traverse(batches):
        """Rows of one node are adjacent; whole nodes are gathered up to TRAVERSE_ROWS."""
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(0).to_numpy(), *(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))])
            size += batch.num_rows
            if size >= TRAVERSE_ROWS and held[0][0][0] != held[-1][0][-1]:
                rows = [np.concatenate(c) for c in zip(*held)]
                cut = np.flatnonzero(rows[0][1:] != rows[0][:-1])[-1] + 1
                yield solve(*(c[:cut] for c in rows))
                held, size = [[c[cut:] for c in rows]], size - cut
        if size:
            yield solve(*(np.concatenate(c) for c in zip(*held)))

    dealt = fps.select("fp", "more").mapInArrow(deal, "node long, fp long, more long")
    return dealt.repartition(shuffle_width(fps.sparkSession), "node").sortWithinPartitions("node").mapInArrow(traverse, "src long, dst long")


def wide_groups(fps: DataFrame) -> DataFrame:
    """(fp, loose) for every fp of fps (fp, more) that the wide budget links to another one; loose is shared by all that are linked."""
    fps = written(fps.groupBy("fp").agg(F.min("more").alias("more")))
    return written(components(wide_links(fps)), few=True).select(F.col("node").alias("fp"), F.col("root").alias("loose"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links.

    Fingerprints link at ``budget`` or fewer differing bits. Equal texts share a
    fingerprint, so copies never multiply into pairs. Null text counts as empty
    (fingerprint 0, linked like any other); rows with a null doc_id get their component,
    whose id is null only if no other row is in it. Empty table: no rows.
    """
    held = written(fingerprints(docs, shingle).select("doc_id", "fp"))
    joined = written(rooted(held.groupBy("fp").agg(F.min("doc_id").alias("least")), budget, prefix_bits))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    return held.join(of, "fp").select("doc_id", "fp", "component_id")


def rooted(groups: DataFrame, budget: int, prefix_bits: int) -> DataFrame:
    """groups (one row for each fp) plus root, which the fingerprints of a component share; the prefix grows with their number."""
    groups = written(groups)
    links = near_links(groups.select("fp"), budget, max(prefix_bits, (groups.count() // NODE_ROWS).bit_length()))
    roots = written(components(links), few=True)
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 2, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays, rows without one last, then by
    text hash.

    Rows that repeat a doc_id with other texts are rows of their own; rows that repeat doc_id and text are one.
    """
    held = written(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("kept")
    best = rooted(held.groupBy("fp").agg(first), budget, prefix_bits).groupBy("root").agg(F.min("kept").alias("kept"))
    kept = best.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.version").alias("kept_version"))
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("own_id"), version.alias("version"))
    stay = own.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version")), "left_semi")
    return stay.dropDuplicates(["own_id", "version"]).select("all.*")
