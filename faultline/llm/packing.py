"""Packing documents into fixed-length sequences by cutting-stock column generation.

Each document is cut into full sequences and one rest. The rests form a histogram of
length classes; a linear program over patterns (how many rests of each class share a
sequence) is solved by column generation on that bounded histogram: a dense revised
simplex for the master, a knapsack dynamic program for the price of new columns. The
solution is rounded down, what is left goes first-fit-decreasing, and the patterns are
handed to the documents by their rank within the class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written
from .tokens import in_runs, word_ids

#: Rests are rounded up to a multiple of this within the plan.
UNIT = 8
#: The document end: one id after each document's own.
END_ID = 1
#: Parts in which the members of a length class are ranked.
SALTS = 256

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (and the end id) into pieces of at most ``capacity``.

    Null and blank texts hold the end id alone. Repeated rows are cut like any other.
    ``with_ids`` adds the piece's ids as binary (unsigned, little-endian, 32 bits).
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    fold = vocabulary is None  # the default vocabulary lower-cases and splits letters from punctuation
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        coder = word_ids(path, fold=fold)
        names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            docs_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in in_runs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                rows: list[tuple] = []
                for doc, blob in zip(docs_of[lo:hi], coder.of_column(texts.slice(lo, hi - lo))):
                    blob += end
                    n = len(blob) // 4
                    for at in range(0, n, capacity):
                        part = blob[4 * at : 4 * (at + capacity)]
                        rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, part))
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.binary()) for c in cols[5:][: int(with_ids)]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA + ", ids binary" * with_ids)


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        k = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if k:
            got = best[w - sizes[:k]] + duals[:k]
            j = int(got.argmax())
            if got[j] > best[w]:
                best[w], pick[w] = got[j], j
    column, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            column[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[capacity]), column


def patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: count}) covering ``demand`` {size: count}: column generation, rounding down, first-fit rest."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([float(demand[int(s)]) for s in sizes])
    m = len(sizes)
    columns = [np.eye(m)[j] * (capacity // s) for j, s in enumerate(sizes)]
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ need
    cost = np.ones(m)
    for _ in range(rounds):
        duals = cost @ inverse
        if duals.min() < -1e-9:  # a surplus column enters
            j = int(duals.argmin())
            column, c = -np.eye(m)[j], 0.0
        else:
            value, column = price(duals, sizes, capacity)
            if value <= 1 + gap:
                break
            c = 1.0
        d = inverse @ column
        up = d > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(ratio.argmin())
        step = max(0.0, ratio[r])
        x = np.maximum(x - step * d, 0)
        x[r] = step
        inverse[r] /= d[r]
        for_others = d.copy()
        for_others[r] = 0
        inverse -= np.outer(for_others, inverse[r])
        columns[r], cost[r] = column, c
    left, out = need.astype(int), []
    for j in np.argsort(-x, kind="stable"):
        a = columns[j].astype(int)
        if cost[j] == 0 or not a.any():
            continue
        times = int(x[j] + 1e-6)
        if times > 0:
            out.append((times, {int(s): int(k) for s, k in zip(sizes, a) if k}))
            left = left - times * a
    left = np.maximum(left, 0)
    bins: list[list] = []  # [room, {size: count}]
    room_from = [0] * (capacity + 1)  # for each size: bins before this one have no room for it
    for j in range(m - 1, -1, -1):
        s = int(sizes[j])
        for _ in range(int(left[j])):
            k = room_from[s]
            while k < len(bins) and bins[k][0] < s:
                k += 1
            if k == len(bins):
                bins.append([capacity, {}])
            room_from[s] = k
            bins[k][0] -= s
            bins[k][1][s] = bins[k][1].get(s, 0) + 1
    same: dict[tuple, int] = {}
    for _, b in bins:
        key = tuple(sorted(b.items()))
        same[key] = same.get(key, 0) + 1
    return out + [(n, dict(key)) for key, n in same.items()]


def assign(cut: DataFrame, capacity: int = 2048, unit: int = UNIT) -> DataFrame:
    """Give each piece a sequence_id and its gapless offset there.

    The histogram, the patterns and the class ranges are bounded by capacity / unit; the
    rank of a piece within its class is taken in salted parts, so that one length held by
    a third of all rows is dealt over many tasks.
    """
    spark = cut.sparkSession
    held = written(
        cut.withColumns({
            "class": F.when(F.col("length") < capacity, F.ceil(F.col("length") / unit).cast("int")),
            "row": F.monotonically_increasing_id(),
            "salt": F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"),
        })
    )
    counts = held.where("class is not null").groupBy("class", "salt").agg(F.count("*").alias("n"))
    counts = written(counts, few=True)
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    ranges: dict[int, list] = {}
    base, used = 0, dict.fromkeys(demand, 0)
    for times, pattern in patterns(demand, -(-capacity // unit)):
        for size, k in pattern.items():
            ranges.setdefault(size, []).append((used[size], used[size] + k * times, k, base))
            used[size] += k * times
        base += times
    table = spark.createDataFrame(list(ranges.items()), "class int, spans array<struct<a:long,b:long,k:long,base:long>>")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("class", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    part = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "row")
    ranked = held.where("class is not null").withColumn("within", F.row_number().over(part) - 1).join(starts, ["class", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).join(F.broadcast(table), "class")
    span = F.filter("spans", lambda s: (F.col("rank") >= s["a"]) & (F.col("rank") < s["b"]))[0]
    ranked = ranked.withColumn("span", span).withColumn("sequence_id", F.col("span.base") + F.floor((F.col("rank") - F.col("span.a")) / F.col("span.k")))
    names = cut.columns
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    rests = ranked.select(*names, "row", F.col("sequence_id").cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    full = held.where("class is null").select(*names, (F.lit(base) + F.col("row")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rests.drop("row").unionByName(full)


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` ids.

    Null text: the end id alone. Empty table: no rows. Columns of docs other than doc_id
    and text are ignored. Repeated rows and equal lengths: each row is packed on its own.
    """
    return assign(pieces(docs, capacity, vocabulary, with_ids), capacity)


def sequences(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids binary (pieces joined in order)."""
    packed = pack(docs, capacity, vocabulary, with_ids=True)
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))
