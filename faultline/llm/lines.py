"""Line de-duplication by pairwise alignment of documents that share rare lines."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import forget, in_parts

#: Words that a common block must hold to be deleted; chance-equal short lines stay.
MIN_BLOCK_WORDS = 10

_RUNS = "key long, version long, run long, lines array<long>, words array<int>, ords array<int>, at array<int>"
_LINES = "key long, version long, line long, n_words int, ords array<int>, at array<int>"


def _keyed(docs: DataFrame) -> DataFrame:
    """key orders the documents: doc_id, then rows without one (by hash); version tells texts of one doc_id apart."""
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    last = F.lit(1 << 62) + F.shiftrightunsigned(version, 2)
    return docs.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), last), "version": version})


def line_table(keyed: DataFrame) -> DataFrame:
    """One row for each distinct line with a word of each document: its places among such lines and among all lines."""

    def split(batches):
        from xxhash import xxh64_intdigest

        forget()
        types = [pa.int64()] * 3 + [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _LINES.split(", ")]
        for batch in batches:
            keys, versions, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in in_parts(texts):
                cols: list[list] = [[] for _ in names]
                for key, version, text in zip(keys[lo:hi], versions[lo:hi], texts[lo:hi]):
                    places: dict[bytes, tuple[list, list]] = {}
                    n = 0
                    for i, line in enumerate((text or "").encode().split(b"\n")):
                        if line := line.strip():
                            ords, at = places.setdefault(line, ([], []))
                            ords.append(n)
                            at.append(i)
                            n += 1
                    for line, (ords, at) in places.items():
                        h = xxh64_intdigest(line)
                        for c, v in zip(cols, (key, version, h - (1 << 64) if h >> 63 else h, len(line.split()), ords, at)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return keyed.select("key", "version", "text").mapInArrow(split, _LINES)


def runs_of(rows: list[dict], min_words: int) -> dict[tuple, list[list[tuple]]]:
    """{line hashes: places} of the runs of two lines or more that just reach ``min_words`` from their first line on or back
    from their last, over shared lines that follow each other. Each line of a longer block is in one of its runs or long enough alone."""
    places = sorted((o, r["line"], r["n_words"], k) for r in rows for o, k in zip(r["ords"], r["at"]))
    sums = [0, *accumulate(x[2] for x in places)]
    edge = [0, *(i for i in range(1, len(places)) if places[i][0] != places[i - 1][0] + 1), len(places)]
    spans = set()
    for lo, hi in zip(edge, edge[1:]):
        ahead = [(i, bisect_left(sums, sums[i] + min_words)) for i in range(lo, hi)]
        back = [(bisect_right(sums, sums[i + 1] - min_words) - 1, i + 1) for i in range(lo, hi)]
        spans.update((a, b) for a, b in ahead + back if lo <= a and b <= hi)
    out: dict[tuple, list[list[tuple]]] = {}
    for a, b in sorted(spans):
        if b - a > 1:
            out.setdefault(tuple(x[1] for x in places[a:b]), []).append(places[a:b])
    return out


def run_table(shared: DataFrame, min_words: int) -> DataFrame:
    """The runs of each document's shared lines, with their lines, first places among lines with words, and places of all their lines."""

    def build(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            out: list[tuple] = []
            for key, version, rows in zip(*(c.to_pylist() for c in batch.columns)):
                for held, places in runs_of(rows, min_words).items():
                    h = xxh64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in held))
                    out.append((key, version, h - (1 << 64) if h >> 63 else h, held, [x[2] for x in places[0]], [p[0][0] for p in places], [x[3] for p in places for x in p]))
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 3
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[c.split()[0] for c in _RUNS.split(", ")])

    rows = shared.groupBy("key", "version").agg(F.collect_set(F.struct("line", "n_words", "ords", "at")).alias("rows"))
    return rows.mapInArrow(build, _RUNS)


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing run of picks."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j), a[i] == b[j], by patience diff: lines unique to both ranges anchor, then the gaps."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        once_a, once_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {x: i for i, x in enumerate(a[i0:i1], i0) if once_a[x] == 1 and once_b[x] == 1}
        both = [(place[x], j) for j, x in enumerate(b[j0:j1], j0) if x in place]
        anchors = [both[k] for k in longest_increasing([i for i, _ in both])]
        if not anchors:
            continue
        out += anchors
        i, j = i0, j0
        for x, y in [*anchors, (i1, j1)]:
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
    return sorted(out)


def doomed_lines(rows: list[dict], min_words: int) -> list[int]:
    """Line numbers to delete from a document, given its lines, and runs of lines, shared with earlier owners."""
    out: set[int] = set()
    owners: dict[int, list[dict]] = {}
    for r in rows:
        owners.setdefault(r["owner"], []).append(r)
    for shared in owners.values():
        info, theirs, own = {}, set(), {}
        for r in shared:
            held = r["lines"]
            info.update(zip(held, r["words"]))
            theirs.update((o + k, x) for o in r["owner_ords"] for k, x in enumerate(held))
            own.update((o + k, (x, r["at"][i * len(held) + k])) for i, o in enumerate(r["ords"]) for k, x in enumerate(held))
        if sum(info[x] for x, _ in own.values()) < min_words:
            continue
        a = sorted(theirs)
        b = sorted((o, x, k) for o, (x, k) in own.items())
        block: list[int] = []
        words, last = 0, (-2, -2)
        for i, j in [*patience([x[1] for x in a], [x[1] for x in b]), (-1, -1)]:
            here = (a[i][0], b[j][0]) if i >= 0 else (-9, -9)
            if here != (last[0] + 1, last[1] + 1):
                if words >= min_words:
                    out.update(block)
                block, words = [], 0
            if i >= 0:
                block.append(b[j][2])
                words += info[b[j][1]]
            last = here
    return sorted(out)


def repeated_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(key, version, doomed array<int>): for each document with any, the numbers of its lines to delete.

    A line hash held by two or more documents is owned by the earliest; so is a run of shared
    lines that follow each other and just reach ``min_words``. Every later document is paired with the owners of
    its lines and of its runs, so each repeated block meets documents that hold its runs whole. Each shared line or run
    is a row once, however many documents hold it. Repeated rows of one key and version count once.
    """
    lines = written(line_table(_keyed(docs)))
    owners = written(lines.groupBy("line").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), few=True)
    shared = written(lines.join(owners, "line"))
    runs = written(run_table(shared, min_words))
    run_owners = written(runs.groupBy("run").agg(F.min("key").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), few=True)
    shared_runs = runs.join(run_owners, "run")

    def later(rows: DataFrame, of: str, *columns) -> DataFrame:
        own = rows.where("key = owner").groupBy(of).agg(F.min_by("ords", "version").alias("owner_ords"))
        return rows.where("key <> owner").join(own, of).select("key", "version", F.struct(*columns, "ords", "at", "owner", "owner_ords").alias("row"))

    both = later(shared, "line", F.array("line").alias("lines"), F.array("n_words").alias("words")).unionByName(later(shared_runs, "run", "lines", "words"))
    gathered = both.groupBy("key", "version").agg(F.collect_set("row").alias("rows"))

    def align(batches):
        for batch in batches:
            doomed = [doomed_lines(rows, min_words) for rows in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(doomed, pa.list_(pa.int32()))], names=["key", "version", "doomed"])

    return gathered.mapInArrow(align, "key long, version long, doomed array<int>").where("size(doomed) > 0")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS, report: bool = False) -> DataFrame:
    """docs with the aligned common blocks deleted from the later document.

    Lines are split at \\n and compared without white space at their ends; a block is a run of
    lines that follow each other in both documents and is deleted if it has ``min_words``
    words or more. The earliest holder (by doc_id) of each line keeps it. Null text stays null; rows
    repeating both doc_id and text are one document; rows with a null doc_id come last. A document
    may end up empty. ``report`` adds n_lines and doomed (the numbers of the deleted
    lines). Columns named key, version or doomed in docs are kept apart by a prefix.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"))
    found = repeated_lines(docs.select("doc_id", "text"), min_words)
    joined = _keyed(packed).join(found, ["key", "version"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("doomed", i)), "\n")
    text = F.when(F.col("doomed").isNull(), F.col("text")).otherwise(kept)
    out = [text.alias("text") if c == "text" else F.col("all")[c].alias(c) for c in names]
    if report:
        out += [F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.coalesce("doomed", F.array().cast("array<int>")).alias("doomed")]
    return joined.select(*out)
