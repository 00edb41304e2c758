"""Scoring texts with a causal self-attention model on subword ids.

A token is a word, or the end of a text. The model reads the tokens before it, each as the sum of the evidence
vectors of its subword ids, in overlapping windows under a causal mask, and gates a few experts, which are
distributions over tokens. An expert gives a training word its discounted corpus share, weighed by how likely the
word's ids make the expert, and any word a spelling, id by id: a first id, then end or go on by the last id, class by the last id, id
within its class after the class of the last. A second, hard head attends to the latest place of the window where
the last tokens stood before, and expects what followed there as often as that came true in training. Experts come from which ids stand near which
others in all training texts (a mixture fitted to the table of ids by hashed neighbours), spellings from all distinct training words; the
attention weights are trained in numpy on every window of every training document, half of them in each of two
rounds, task by task, and averaged by Spark after each round.
"""

from __future__ import annotations

import math
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, small_batches, written
from .tokens import forget, in_runs, word_ids

#: Tokens of a window, of these context only, width of the attention, experts, classes of ids in spellings.
WINDOW, OVERLAP, WIDTH, EXPERTS, CLASSES = 32, 8, 16, 8, 64
#: Most tokens that a copy is recognised by.
COPY = 3
#: Ids are described by the tokens up to REACH places away, whose first ids are hashed into BUCKETS.
REACH, BUCKETS = 4, 64
#: Averaged rounds of training, each over its share of all windows; windows in a step, and the rate of the steps.
ROUNDS, BATCH, RATE = 2, 64, 0.02
#: Windows whose arrays are held at once: they stay in the processor's cache and are not given back to the system each time.
BLOCK = 32
#: Most words whose counts are handed to every worker, as a cache; all other words are joined to their counts.
FREQUENT = 200_000
SCALE = 16
END = b"\n"  # no word holds it


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SIZE, END_ID = 50257, 50256  # ids of that vocabulary, the last for the end of a text


def coder():
    return word_ids(vocabulary_path(), "<u2", prefix=" ", ordinary=True)


_SEEDED: dict[str, object] = {}


def seeded(tag: str, broadcast):
    """This worker's encoder, and of the frequent words: place by word, all ids and where each word's start, log counts and levels by place (last: any other word)."""
    if _SEEDED.get("of") != tag:
        _SEEDED.clear()
        tokens, counts, levels, pool, starts = broadcast.value
        places = {w: i for i, w in enumerate(tokens)}
        _SEEDED.update(of=tag, held=(coder(), places, pool, starts, np.log10(np.append(counts, 1) + 0.5), np.append(levels, 0).astype("<u2")))
    return _SEEDED["held"]


def unseeded() -> None:
    """Give up what seeded() holds, with the worker's vocabularies: later steps know ids only."""
    _SEEDED.clear()
    forget()


def prepared(texts: list | pa.Array, coding, places: dict, pool: np.ndarray, pool_starts: np.ndarray, logs: np.ndarray, levels: np.ndarray) -> list[list]:
    """Columns of each text: n_tokens, n_often, often_sum, rare words, which of them stands at each zero of levels, levels, ids."""
    words, n = words_of_column(texts)
    codes = words.dictionary_encode()
    distinct, code = bytes_of(codes.dictionary.cast(pa.binary())), codes.indices.to_numpy()
    place = np.fromiter(map(places.get, distinct, repeat(-1)), np.int64, len(distinct))
    known, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    new_words = [distinct[i] for i in new.tolist()]
    frequent_ids = lambda w: None if (i := places.get(w)) is None else pool[pool_starts[i] : pool_starts[i + 1]].tobytes()
    coded = coding.looked_up(new_words, frequent_ids)
    blobs = [coded[w] for w in new_words]
    sizes, sources = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
    sizes[known], sources[known] = np.diff(pool_starts)[place[known]], pool_starts[place[known]]
    sizes[new] = size = np.array([len(b) // 2 for b in blobs], np.int64)
    sources[new] = len(pool) + np.cumsum(size) - size
    at, lengths = place[code], sizes[code]
    doc, often = np.repeat(np.arange(len(texts)), n), at >= 0
    rare_at = np.flatnonzero(~often)
    rare_words = [distinct[i] for i in code[rare_at].tolist()]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.concatenate([pool, np.frombuffer(b"".join(blobs), "<u2")])[np.arange(starts[-1]) + np.repeat(sources[code] - starts[:-1], lengths)]
    first = np.concatenate([[0], np.cumsum(n)])
    end = places.get(END, -1)
    sums = np.bincount(doc[often], logs[at[often]], len(texts)) + (logs[end] if end >= 0 else 0.0)
    counts = np.bincount(doc[often], minlength=len(texts)) + (end >= 0)
    level = levels[at]
    cut = np.searchsorted(doc[rare_at], np.arange(len(texts) + 1)).tolist()
    out: list[list] = [[] for _ in range(7)]
    for i in range(len(texts)):
        rare: dict[bytes, int] = {}
        which = np.array([rare.setdefault(w, len(rare)) for w in rare_words[cut[i] : cut[i + 1]] + [END] * (end < 0)], "<u4")
        blob = ids[starts[first[i]] : starts[first[i + 1]]].tobytes()
        row = (
            n[i] + 1, counts[i], sums[i], list(rare), which.tobytes(),
            level[first[i] : first[i + 1]].tobytes() + levels[end].tobytes(), blob,
        )
        for column, value in zip(out, row):
            column.append(value)
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def words_of_column(texts: list | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of() all texts, one after the other, and their number in each text."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    words, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)  # of a text without words
    n -= np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
    return words.filter(pa.array(~empty)), n


def parts_of(texts: pa.Array):
    """in_parts() of a column."""
    return in_runs(pc.utf8_length(texts).fill_null(0).to_pylist())


# --- corpus statistics -----------------------------------------------------------------------------------------


def token_counts(docs: DataFrame) -> DataFrame:
    """(token binary, c long, ids binary): counts of all words and ends, and the subword ids of each."""

    def count(batches):
        for batch in batches:
            for lo, hi in parts_of(batch.column(0)):
                words, _ = words_of_column(batch.column(0).slice(lo, hi - lo))
                held = words.value_counts()
                tokens, c = pa.concat_arrays([held.field(0).cast(pa.binary()), pa.array([END])]), pa.concat_arrays([held.field(1), pa.array([hi - lo])])
                yield pa.RecordBatch.from_arrays([tokens, c], names=["token", "c"])

    def encode(batches):
        coding = coder()
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            tokens = bytes_of(batch.column(0))
            known = coding.looked_up([t for t in tokens if t != END])
            ids = [end if t == END else known[t] for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["token", "c", "ids"])

    partial = docs.select("text").mapInArrow(count, "token binary, c long")
    return written(partial.groupBy("token").agg(F.sum("c").alias("c")).mapInArrow(encode, "token binary, c long, ids binary"))


def bytes_of(column: pa.Array) -> list[bytes]:
    """to_pylist() in a fraction of its time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def ragged(blobs: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and where each blob starts."""
    blobs = pa.array(blobs, pa.binary()) if isinstance(blobs, list) else blobs
    _, edges, data = blobs.buffers()
    if not len(blobs):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    edges = np.frombuffer(edges, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    ids = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]].tobytes()
    return np.frombuffer(ids, "<u2").astype(np.int64), (edges - edges[0]) // 2


def sliced(batch: pa.RecordBatch, rows: int):
    """The batch in slices, so that neither side holds it as a whole once more."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def cell_sums(batches, cells, size: int):
    """(k, v) of the cells seen in batches of (c, ids), in slices. A dictionary of them would take ten times the array."""
    unseeded()
    total = np.zeros(size)
    for batch in batches:
        ids, starts = ragged(batch.column(1))
        at, weight = cells(ids, starts, batch.column(0).to_numpy())
        np.add.at(total, at, weight)
    seen = np.flatnonzero(total)
    yield from sliced(pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["k", "v"]), 50_000)


def summed(counts: DataFrame, cells, size: int) -> np.ndarray:
    """Sum of ``size`` cells over the token table: cells(ids, starts, c) gives (positions, weights); rows per cell meet by key."""
    rows = counts.select("c", "ids").mapInArrow(lambda batches: cell_sums(batches, cells, size), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    return rows.sort_values("k").to_numpy()


def unigram_cells(buckets: int):
    """Counts over distinct tokens of each id (cell 0) and of its neighbours within words, hashed into buckets before and after it."""

    def cells(ids, starts, c):
        weight = np.ones(len(ids))
        inner = np.ones(len(ids), bool)
        inner[starts[:-1][starts[:-1] < len(ids)]] = False
        right = np.flatnonzero(inner)
        mix = lambda x: (x * 0x9E3779B1 >> 7) % buckets
        wide = 1 + 2 * buckets
        at = [ids * wide, ids[right] * wide + 1 + mix(ids[right - 1]), ids[right - 1] * wide + 1 + buckets + mix(ids[right])]
        return np.concatenate(at), np.concatenate([weight, weight[right], weight[right]])

    return cells


def clustered(cells: np.ndarray, buckets: int, k: int = CLASSES, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(count of each id, class of each id): spherical k-means of the ids by their neighbours; the end is a class of its own."""
    wide = 1 + 2 * buckets
    table = np.zeros((SIZE, wide))
    at = cells[:, 0].astype(np.int64)
    table.ravel()[at] = cells[:, 1]
    count = table[:, 0]
    seen = np.flatnonzero(count > 0)
    seen = seen[seen != END_ID]
    classes = np.arange(SIZE) % (k - 1)  # ids never seen share out
    if len(seen):
        x = np.sqrt(table[seen, 1:] + 0.1)
        x = np.concatenate([x, np.sqrt(np.maximum(1, 2 * count[seen] - table[seen, 1:].sum(1)))[:, None]], 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        order = np.argsort(-count[seen], kind="stable")
        centres = x[order[: k - 1]]
        for _ in range(turns):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x * np.sqrt(count[seen])[:, None])
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
        classes[seen] = near
    classes[END_ID] = k - 1
    return count, classes.astype(np.int64)


def follower_cells(classes: np.ndarray, k: int):
    """Cells over distinct tokens, each counted once, in two blocks: (id, class of the next id) within words, (id, k) at their
    ends and (SIZE, class of the first id); (class of the last id, id) within words and (k, id) at starts."""

    def cells(ids, starts, c):
        first, last = starts[:-1], starts[1:] - 1
        inner = np.ones(len(ids), bool)
        inner[first] = False
        right = np.flatnonzero(inner)
        second = (SIZE + 1) * (k + 1)
        at = [
            ids[right - 1] * (k + 1) + classes[ids[right]], ids[last] * (k + 1) + k, SIZE * (k + 1) + classes[ids[first]],
            second + classes[ids[right - 1]] * SIZE + ids[right], second + k * SIZE + ids[first],
        ]
        return np.concatenate(at), np.ones(sum(map(len, at)))

    return cells


def neighbours(held: DataFrame) -> np.ndarray:
    """(SIZE, BUCKETS) table over the texts of ``ids``: how often each id stands, in whatever token, up to REACH tokens from one whose first id is in the bucket.

    Tasks sum tables of their own, so a row for each id and task moves, and the table that reaches the driver is bounded by the vocabulary.
    """
    opens = coder_opens()

    def run(batches):
        unseeded()
        total = np.zeros(SIZE * (BUCKETS + 1), np.int64)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for lo in range(0, len(blobs), 50):
                count_neighbours(total, *streamed(blobs[lo : lo + 50]), opens)
        table = total.reshape(SIZE, -1)[:, :BUCKETS]
        seen = np.flatnonzero(table.any(1))
        columns = [pa.array(seen)] + [pa.array(table[seen, b]) for b in range(BUCKETS)]
        yield from sliced(pa.RecordBatch.from_arrays(columns, names=["id", *map(str, range(BUCKETS))]), 2_000)

    names = [str(b) for b in range(BUCKETS)]
    rows = held.select("ids").mapInArrow(run, ", ".join(["id long", *(f"`{b}` long" for b in names)])).groupBy("id").agg(*[F.sum(f"`{b}`").alias(b) for b in names]).toPandas()
    out = np.zeros((SIZE, BUCKETS))
    out[rows["id"].to_numpy(np.int64)] = rows[names].to_numpy(float)
    return out


def count_neighbours(total: np.ndarray, stream: np.ndarray, opens: np.ndarray) -> None:
    """Add the counts of one stream of texts to the flat table, with a last bucket for the ends of texts and what lies beyond them."""
    begins = np.flatnonzero(opens[stream])
    first, sizes = stream[begins], np.diff(np.append(begins, len(stream)))
    ends = first == END_ID
    beyond = np.full(REACH, -1)
    bucket = np.concatenate([beyond, np.where(ends, BUCKETS, (first * 0x9E3779B1 >> 7) % BUCKETS), beyond])
    text = np.concatenate([beyond, np.cumsum(ends) // 2, beyond])  # an end stands before and after each text
    at, sizes = np.flatnonzero(~ends) + REACH, sizes[~ends]
    base = stream[stream != END_ID] * (BUCKETS + 1)
    for off in range(-REACH, REACH + 1):
        if off:
            near = np.where(text[at + off] == text[at], bucket[at + off], BUCKETS)
            np.add.at(total, base + np.repeat(near, sizes), 1)


def experts(table: np.ndarray, k: int = EXPERTS, turns: int = 150, starts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(evidence of each id for each expert, log share of each expert): the mixture of k id distributions that explains the table best.

    Expectation maximisation on the table, from ``starts`` fixed beginnings. Evidence is the log of how much likelier the expert makes the id.
    """
    evidence = np.zeros((SIZE, k), np.float32)
    seen = np.flatnonzero(table.any(1))
    if not len(seen):
        return evidence, np.full(k, -math.log(k))
    p = table[seen] / table[seen].sum()
    best = (-np.inf, None, None)
    for start in range(starts):
        rng = np.random.default_rng(start)
        of, by = rng.random((len(p), k)) + 0.1, rng.random((k, p.shape[1])) + 0.1
        of, by = of / of.sum(0), by / by.sum()
        for _ in range(turns):
            ratio = p / np.maximum(of @ by, 1e-300)
            of, by = of * (ratio @ by.T), by * (of.T @ ratio)
            of /= np.maximum(of.sum(0), 1e-300)
        fit = (p * np.log(np.maximum(of @ by, 1e-300))).sum()
        if fit > best[0]:
            best = fit, of, by.sum(1) / by.sum()
    _, of, share = best
    share = np.maximum(share, 1e-9)
    joint = of * share + 3.0 / table.sum() * share
    joint /= joint.sum(0)
    evidence[seen] = np.clip(np.log(joint / (joint * share).sum(1, keepdims=True)), -5, 5)
    return evidence, np.log(share / share.sum())


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def softmax_of_rows(x: np.ndarray) -> np.ndarray:
    """Softmax along the first axis, in place: numpy works through long rows much faster than through many short ones."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def token_evidence(ids: np.ndarray, begins: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Summed evidence of the ids of each token."""
    if not len(begins):
        return np.zeros((0, evidence.shape[1]), np.float32)
    lengths = np.diff(np.append(begins, len(ids)))
    total, longer = evidence.take(ids[begins], axis=0), np.arange(len(begins))
    for place in range(1, 8):  # most tokens have few ids
        longer = longer[lengths[longer] > place]
        total[longer] += evidence.take(ids[begins[longer] + place], axis=0)
    longer = longer[lengths[longer] > 8]
    if len(longer):
        at = np.repeat(begins[longer] + 8 - np.append(0, np.cumsum(lengths[longer] - 8)[:-1]), lengths[longer] - 8)
        at += np.arange(len(at))
        total[longer] += np.add.reduceat(evidence[ids[at]], np.append(0, np.cumsum(lengths[longer] - 8)[:-1]))
    return np.clip(total, -12, 12, out=total)


_EARLIER = np.tri(WINDOW, k=-1, dtype=bool)
_MARKS = np.random.default_rng(5).integers(1, 1 << 62, SIZE, np.uint64)


def token_marks(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ids of each token."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    within = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    powers = np.multiply.accumulate(np.full(within.max() + 1, 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat(_MARKS[ids] * powers[within], begins)


def copied(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of token hashes, for each place: how many of the last tokens (0 to COPY) also stand earlier in the window, and whether the
    token that followed there comes next. Of the longest such runs the latest counts."""
    n, bits, low = len(marks), WINDOW.bit_length() - 1, WINDOW - 1
    short = marks[:, :-1].astype(np.uint16)
    same = short[:, :, None] == short[:, None, :]
    same &= _EARLIER
    same = same.ravel()
    eights = np.flatnonzero(same.view(np.uint64))  # few places hold equal tokens
    pair = (eights[:, None] * 8 + np.arange(8))[same.reshape(-1, 8).take(eights, axis=0)]
    marks = marks.ravel()
    place, earlier = pair >> bits, pair & low
    start = (place >> bits) * (WINDOW + 1)
    equal = marks.take(start + (place & low)) == marks.take(start + earlier)
    if not equal.all():  # some are alike in their last 16 bits only
        same[pair[~equal]] = False
        pair, place, earlier, start = (x[equal] for x in (pair, place, earlier, start))
    longest = np.ones(len(pair), np.int64)
    run, before = np.arange(len(pair)), pair
    for _ in range(COPY - 1):
        before = before - (WINDOW + 1)  # the tokens before both; where there is none this is a pair that is not earlier, in this window or the last
        going = same.take(before, mode="wrap")
        run, before = run[going], before[going]
        longest[run] += 1
    length, right = np.zeros(n * WINDOW, np.int64), np.zeros(n * WINDOW, bool)
    if len(pair):
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        best = np.maximum.reduceat((longest << bits) + earlier, first)
        place, start = place[first], start[first]
        length[place] = best >> bits
        right[place] = marks.take(start + (best & low) + 1) == marks.take(start + (place & low) + 1)
    return length.reshape(n, WINDOW), right.reshape(n, WINDOW)


def masses(counts: DataFrame, evidence: np.ndarray, prior: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(2, k): of each expert, its part of all training tokens and of the discounted shares of the training words."""
    k = len(prior)

    def run(batches):
        total = np.zeros((2, k))
        for batch in batches:
            ids, starts = ragged(batch.column(1))
            c = batch.column(0).to_numpy()
            belongs = softmax(prior + token_evidence(ids, starts[:-1], evidence))
            level = np.floor(np.log2(c) * SCALE).astype(np.int64) + 1
            total += np.stack([c @ belongs, shares[level] @ belongs])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k)), pa.array(total.ravel())], names=["k", "v"])

    rows = counts.select("c", "ids").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * k)
    for r in rows:
        out[r["k"]] = r["v"]
    return out.reshape(2, k)


def coder_opens() -> np.ndarray:
    """Which ids begin a token."""
    edge = coder().edge
    opens = np.append(edge, np.zeros(max(0, SIZE - len(edge)), bool))
    opens[END_ID] = True
    return opens


class Statistics:
    """What the model takes from the training tokens, bounded by the vocabulary of ids."""

    def __init__(self, counts: DataFrame, total: int, shares: np.ndarray, table: np.ndarray, k: int = CLASSES, buckets: int = 16):
        self.k, self.opens = k, coder_opens()
        self.evidence, self.prior = experts(table)
        part, known = masses(counts, self.evidence, self.prior, shares)
        part = part / max(total, 1)
        left = np.maximum(part - known, 1e-3 * part) + 1e-12  # of each expert, what is spelled
        self.per, self.left = 1 / (known + left), left / (known + left)
        count, self.classes = clustered(summed(counts, unigram_cells(buckets), SIZE * (1 + 2 * buckets)), buckets, k)
        cells = np.zeros((SIZE + 1) * (k + 1) + (k + 1) * SIZE)
        pairs = summed(counts, follower_cells(self.classes, k), len(cells))
        cells[pairs[:, 0].astype(np.int64)] = pairs[:, 1]
        table = cells[: (SIZE + 1) * (k + 1)].reshape(SIZE + 1, k + 1)
        plain = np.bincount(self.classes, count + 0.1, k)
        follow = table[:, :k] + 2.0 * plain / plain.sum()
        self.follow = np.log(follow / follow.sum(1, keepdims=True)).astype(np.float32)
        ends = (table[:SIZE, k] + 0.5) / (table[:SIZE].sum(1) + 1)
        ends[END_ID] = 1 - 1e-9
        self.ends, self.goes_on = np.log(ends), np.log1p(-ends)
        after = cells[(SIZE + 1) * (k + 1) :].reshape(k + 1, SIZE)
        after = after + 5.0 * (count + 0.1) / plain[self.classes]
        for c in range(k + 1):
            after[c] /= np.bincount(self.classes, after[c], k)[self.classes]
        self.share = np.log(after).astype(np.float32)
        start = np.exp(self.follow[SIZE][self.classes] + self.share[k])[:, None] * softmax(self.prior + self.evidence)
        self.start = (start / start.sum(0)).astype(np.float32)  # first ids of spellings by expert


# --- the model -------------------------------------------------------------------------------------------------


def shapes(k: int) -> dict[str, tuple]:
    d = WIDTH
    return {"lift": (k, d), "place": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "out": (d, k), "skip": (k, k), "bias": (1, k)}


def fresh(prior: np.ndarray) -> np.ndarray:
    """All weights in one array; the last layer starts at zero, so the model starts at the shares of the experts."""
    rng = np.random.default_rng(1)
    made = {n: np.zeros(s) if n in ("out", "skip") else rng.normal(0, 0.1 if n == "lift" else 0.3, s) for n, s in shapes(len(prior)).items()} | {"bias": prior}
    return np.concatenate([made[n].ravel() for n in shapes(len(prior))]).astype(np.float32)


def split(flat: np.ndarray, k: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(k).items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def joined(w: dict) -> tuple:
    """What forward() makes of a token's evidence and of its place, as matrices: queries and keys act as one, values and what is made of them too.

    Columns: what stands at the place, asks, is made of it; the evidence; a one, which sums the attention. Then the last layer of evidence and one."""
    d, (k, _) = WIDTH, w["lift"].shape
    kind = w["lift"].dtype
    both = np.concatenate([np.eye(d, dtype=kind), w["q"] @ w["k"].T / math.sqrt(d), w["v"] @ w["o"]], axis=1)
    of_seen = np.concatenate([w["lift"] @ both, np.eye(k, k + 1, dtype=kind)], axis=1)
    of_place = np.concatenate([w["place"] @ both, np.eye(WINDOW, k + 1, -WINDOW, dtype=kind)], axis=1)
    of_place[:, -1] = 1
    return both, of_seen, of_place, np.concatenate([w["skip"], w["bias"]])


def forward(w: dict, seen: np.ndarray, since: int = 0, joint: tuple | None = None):
    """Logits of the experts of the next token at the places from ``since`` of windows of token evidence, and the same with the experts first, all
    places in a row, with what the backward pass needs. joint: joined(w)."""
    n, d, k = len(seen), WIDTH, seen.shape[2]
    _, of_seen, of_place, last = joint or joined(w)
    made = (seen.reshape(-1, k) @ of_seen).reshape(n, WINDOW, -1)
    made += of_place
    x, asked, values = made[:, :, :d], made[:, since:, d : 2 * d], made[:, :, 2 * d :]
    a = np.matmul(asked, x.transpose(0, 2, 1))
    a += _MASK[since:]
    a -= np.maximum.reduceat(a.ravel(), np.arange(0, a.size, WINDOW)).reshape(n, -1, 1)  # a third of the time of max() over short rows
    np.exp(a, out=a)
    mixed = np.matmul(a, values)
    part = 1 / mixed[:, :, -1:]
    mixed *= part
    hidden = x[:, since:] + mixed[:, :, :d]
    np.tanh(hidden, out=hidden)
    logits = w["out"].T @ hidden.reshape(-1, d).T
    logits += last.T @ mixed.reshape(-1, d + k + 1)[:, d:].T
    return logits.reshape(k, n, -1).transpose(1, 2, 0), (logits, made, a, mixed, part, hidden)


def gradient(w: dict, seen: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
    """Gradient of the weighted mean log loss of the ids of the next token under the mixture of experts: the sum over blocks of windows.

    Windows without weight at the places that repeat an earlier window ask nothing there."""
    d, part = WIDTH, (weight / max(weight.sum(), 1)).astype(seen.dtype)
    early, joint, blocks = weight[:, :OVERLAP].any(1), joined(w), []
    for since, of in ((0, np.flatnonzero(early)), (OVERLAP, np.flatnonzero(~early))):
        blocks += [block_gradient(w, joint, seen[at], target[at, since:], part[at, since:], since) for at in np.split(of, range(BLOCK, len(of), BLOCK)) if len(at)]
    out, last, of_seen, of_place = (sum(parts) for parts in zip(*blocks))
    both = w["lift"].T @ of_seen[:, d:] + w["place"].T @ of_place[:, d:]
    asked, made = both[:, :d] / math.sqrt(d), both[:, d:]
    return {
        "out": out, "skip": last[:-1], "bias": last[-1:], "lift": of_seen @ joint[0].T, "place": of_place @ joint[0].T,
        "q": asked @ w["k"], "k": asked.T @ w["q"], "v": made @ w["o"].T, "o": w["v"].T @ made,
    }


def block_gradient(w: dict, joint: tuple, seen: np.ndarray, target: np.ndarray, part: np.ndarray, since: int) -> tuple:
    """Gradient of the log loss at the places from ``since``, summed with weights ``part``: of the last layer's two matrices, and of what is joined, by evidence and by place."""
    d, n, k = WIDTH, len(seen), seen.shape[2]
    _, (logits, made, a, mixed, share, hidden) = forward(w, seen, since, joint)
    p = softmax_of_rows(logits + target.reshape(-1, k).T)
    np.subtract(softmax_of_rows(logits), p, out=p)
    p *= part.ravel()
    hidden, mixed = hidden.reshape(-1, d), mixed.reshape(-1, d + k + 1)
    out, last = (p @ hidden).T, (p @ mixed[:, d:]).T
    back = p.T @ np.concatenate([w["out"], joint[3]]).T  # gradient of what was mixed, then of the products with the values
    hidden *= hidden
    np.subtract(1, hidden, out=hidden)
    back[:, :d] *= hidden
    dx = np.empty((n, WINDOW, 3 * d), seen.dtype)
    dx[:, :since, d : 2 * d] = 0
    dz = back[:, :d].copy().reshape(n, -1, d)
    back[:, -1] = 0
    back[:, -1] = -np.einsum("ij,ij->i", back, mixed)
    back *= share.reshape(-1, 1)
    back = back.reshape(n, -1, d + k + 1)
    ds = np.matmul(back, made[:, :, 2 * d :].transpose(0, 2, 1))
    ds *= a
    np.matmul(ds.transpose(0, 2, 1), made[:, since:, d : 2 * d], out=dx[:, :, :d])
    dx[:, since:, :d] += dz
    np.matmul(ds, made[:, :, :d], out=dx[:, since:, d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), back[:, :, :d], out=dx[:, :, 2 * d :])
    return out, last, seen.reshape(-1, k).T @ dx.reshape(-1, 3 * d), dx.sum(0)


def windows(lengths: np.ndarray, choose=None) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over a stream of texts with ``lengths`` predictions each.

    In the stream each text is preceded by one token (an end) and has its predictions after it.
    Returns (places of WINDOW + 1 tokens for each window, fresh): place t predicts place t + 1;
    fresh marks the predictions that no earlier window of the text makes. Short windows are filled up at their end.
    choose, given the text of every window and its number within the text, says which are wanted.
    """
    step = WINDOW - OVERLAP
    runs = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.repeat(np.arange(len(lengths)), runs)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    if choose is not None:
        wanted = choose(text, turn)
        text, turn = text[wanted], turn[wanted]
    place = (turn * step)[:, None] + np.arange(WINDOW + 1)
    most = lengths[text][:, None]
    first = (np.arange(WINDOW) >= OVERLAP) | (turn == 0)[:, None]
    return base[text][:, None] + np.minimum(place, most), (place[:, :-1] < most) & first


def streamed(blobs: list[bytes], opens: np.ndarray | None = None) -> tuple:
    """The stream of the texts' ids, each text preceded and followed by the end id; given opens, also where its tokens begin and the texts' numbers of predictions."""
    end = np.array([END_ID], "<u2").tobytes()
    stream = np.frombuffer(b"".join(end + b + end for b in blobs), "<u2").astype(np.int64)
    if opens is None:
        return (stream,)
    begins = np.flatnonzero(opens[stream])
    edge = np.concatenate([[0], np.cumsum([len(b) // 2 + 2 for b in blobs])])
    return stream, begins, np.diff(np.searchsorted(begins, edge)) - 1


def train(held: DataFrame, stats: Statistics, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Model weights after averaged rounds over all windows of each document of (doc_id, ids), then by length how often a copy goes on."""
    spark = held.sparkSession
    flat, k = fresh(stats.prior), len(stats.prior)
    goes_on = np.full(COPY, 0.01)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((stats.evidence, stats.opens, flat))

        def learn(batches, turn=turn, shared=shared):
            unseeded()
            evidence, opens, flat = shared.value
            flat = flat.copy()
            first, second, steps, done = np.zeros_like(flat), np.zeros_like(flat), 0, 0
            mean = flat.astype(float)  # of the weights along the steps, later ones counting more
            copies = np.zeros((2, COPY + 1))
            for seen, target, weight, marks in training_batches(batches, turn, rounds, opens, evidence):
                if turn == rounds - 1:  # earlier rounds' shares would be overwritten
                    length, right = copied(marks)
                    copies += np.stack([np.bincount(length[weight], minlength=COPY + 1), np.bincount(length[weight & right], minlength=COPY + 1)])
                parts = gradient(split(flat, k), seen, target, weight)
                g = np.concatenate([parts[n].ravel() for n in shapes(k)])
                steps += 1
                done += len(seen)
                first = 0.9 * first + 0.1 * g
                second = 0.99 * second + 0.01 * g * g
                flat -= RATE / math.sqrt(1 + 0.01 * steps) * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-6)
                mean += (flat - mean) * 2 / (steps + 1)
            if done:
                sums = np.concatenate([mean * done, copies[1, 1:] + 0.01]), np.concatenate([np.full(len(flat), float(done)), copies[0, 1:] + 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums[0]), dtype=np.int32)), *map(pa.array, sums)], names=["i", "v", "n"])

        rows = held.select("doc_id", "ids").mapInArrow(learn, "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(rows):
            both = rows.sort_values("i")["v"].to_numpy()
            flat, goes_on = both[: len(flat)].astype(np.float32), both[len(flat) :]
        shared.unpersist()
    return flat, goes_on


def training_batches(batches, turn: int, rounds: int, opens: np.ndarray, evidence: np.ndarray):
    """(token evidence, that of the next tokens, which predictions are fresh, token hashes) of BATCH windows at a time: of each document every ``rounds``-th of its own windows, starting by its id."""
    held: list[list] = [[], [], []]
    size = 0
    for batch in batches:
        keys, blobs = (c.to_pylist() for c in batch.columns)
        for lo in range(0, len(blobs), 200):
            stream, begins, lengths = streamed(blobs[lo : lo + 200], opens)
            tokens, marks = token_evidence(stream, begins, evidence), token_marks(stream, begins)
            start = np.array([k or 0 for k in keys[lo : lo + 200]])
            place, fresh_ = windows(lengths, lambda text, number, start=start: (number + start[text]) % rounds == turn)
            for column, new in zip(held, (tokens.take(place, axis=0), fresh_, marks.take(place))):
                column.append(new)
            size += len(place)
            if size >= BATCH:
                held = [[np.concatenate(c)] for c in held]
                rest = size - size % BATCH
                for at in range(0, rest, BATCH):
                    tokens, fresh_, marks = (c[0][at : at + BATCH] for c in held)
                    yield tokens[:, :-1], tokens[:, 1:], fresh_, marks
                held, size = [[c[0][rest:]] for c in held], size - rest
    if size:
        tokens, fresh_, marks = map(np.concatenate, held)
        yield tokens[:, :-1], tokens[:, 1:], fresh_, marks


def token_terms(blobs: list[bytes], stats: Statistics, w: dict, goes_on: np.ndarray, at_once: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, other, where each text starts) of the tokens of all texts, one after the other: a token's probability is its corpus share times
    exp(known), plus exp(other). Every token is predicted in one window."""
    stream, begins, lengths = streamed(blobs, stats.opens)
    tokens, marks = token_evidence(stream, begins, stats.evidence), token_marks(stream, begins)
    place, fresh_ = windows(lengths)
    gate, run, right = np.zeros_like(tokens), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    early, joint = fresh_[:, 0], joined(w)
    for lo in range(0, len(place), 8 * at_once):
        part, new = place[lo : lo + 8 * at_once], fresh_[lo : lo + 8 * at_once]
        at = part[:, 1:][new]
        run[at], right[at] = (x[new] for x in copied(marks.take(part)))
    for since, of in ((0, np.flatnonzero(early)), (OVERLAP, np.flatnonzero(~early))):  # later windows predict nothing in the overlap
        for lo in range(0, len(of), at_once):
            part, new = place[of[lo : lo + at_once]], fresh_[of[lo : lo + at_once], since:]
            soft = softmax_of_rows(forward(w, tokens.take(part[:, :-1], axis=0), since, joint)[1][0]).T
            gate[part[:, since + 1 :][new]] = soft[new.ravel()]
    lead = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    scored = np.ones(len(begins), bool)
    scored[lead] = False  # the end that precedes a text
    sizes = np.diff(np.append(begins, len(stream)))
    inner = np.ones(len(stream), bool)
    inner[begins] = False
    inner = np.flatnonzero(inner)
    last, next_ = stream[inner - 1], stream[inner]
    spelled = np.bincount(
        np.repeat(np.arange(len(begins)), sizes - 1), stats.goes_on[last] + stats.follow[last, stats.classes[next_]] + stats.share[stats.classes[last], next_], len(begins)
    )
    spelled += stats.ends[stream[begins + sizes - 1]]
    belongs = softmax_of_rows(np.add(stats.prior.astype(tokens.dtype)[:, None], tokens.T, order="C"))
    known = stats.per @ (gate.T * belongs)
    new = (gate * stats.start.take(stream[begins], axis=0)) @ stats.left
    copies = np.append(0.0, goes_on)
    own = np.log1p(-copies)[run]
    other = own + np.log(np.maximum(new, 1e-300)) + spelled
    right = np.flatnonzero(right)
    other[right] = np.logaddexp(other[right], np.log(np.maximum(copies, 1e-300))[run[right]])
    return (own + np.log(np.maximum(known, 1e-300)))[scored], other[scored], lead - np.arange(len(lead))


def judged(blobs: list[bytes], levels: list[bytes], stats: Statistics, w: dict, goes_on: np.ndarray, shares: np.ndarray) -> tuple:
    """Of each text: the summed natural log probability of the tokens with a level; known and other of those without one, and where each text's begin."""
    known, other, starts = token_terms(blobs, stats, w, goes_on)
    level = np.frombuffer(b"".join(levels), "<u2")
    often = level > 0
    token = np.where(often, np.logaddexp(np.log(np.maximum(shares, 1e-300))[level] + known, other), 0.0)
    edges = np.searchsorted(np.flatnonzero(~often), np.append(starts, len(level))).astype(np.int32)
    return np.add.reduceat(token, starts), known[~often], other[~often], edges


def picked(words: pa.ListArray, which: list[bytes]) -> pa.Array:
    """Of each list the words at the places ``which``, one after the other."""
    n = words.value_lengths().to_numpy().astype(np.int64)
    at = np.frombuffer(b"".join(which), "<u4") + np.repeat(np.cumsum(n) - n, [len(x) // 4 for x in which])
    return words.flatten().take(pa.array(at))


# --- the operator ----------------------------------------------------------------------------------------------


def level_of(c: str):
    return F.floor(F.log2(c) * SCALE).cast("int") + 1


def frequent(counts: DataFrame, total: int, most: int) -> tuple[tuple, np.ndarray, float]:
    """The words of highest count, at most ``most``, as (words, counts, levels, ids of all, where each word's ids start); by level, of any training word, its
    share of the training tokens; and the discount of counts in those shares.

    Levels are whole steps of a fine scale of counts, so the table behind the choice is bounded by the scale. Shares are
    discounted by n1 / (n1 + 2 n2), n1 and n2 words of count 1 and 2.
    """
    level = level_of("c")
    steps = {r["l"]: r["n"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}
    one, two = steps.get(1, 0), steps.get(SCALE + 1, 0)
    discount = one / (one + 2 * two) if one else 0.5
    least, held = 64 * SCALE, 0
    for x in sorted(steps, reverse=True):
        held += steps[x]
        if held > most:
            break
        least = x
    floors = 2.0 ** ((np.arange(64 * SCALE) - 1) / SCALE)
    shares = np.maximum(floors - discount, 0) / max(total, 1)
    shares[0] = 0
    rows = counts.where(level >= least).select("token", "c", level.alias("l"), "ids").toArrow().to_pydict()
    pool, starts = ragged(rows["ids"])
    return (rows["token"], np.array(rows["c"], np.int64), np.array(rows["l"], np.int64), pool.astype("<u2"), starts), shares, discount


def score(docs: DataFrame, held_out, classes: int = CLASSES, rounds: int = ROUNDS, most: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Learns from the rows where the column ``held_out`` is not true. base_score is the smoothed
    unigram log10 probability of the words and the end, score the model's of the same
    lower-cased text as subword ids. Null text: empty, the end alone. Repeated rows: each on its own. No training
    rows: nothing is known and the model is near uniform. Empty table: no rows. Other columns are ignored. ``most`` bounds
    a cache and changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = token_counts(docs.where(~F.col("held_out")))
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = n or 0, v or 0
    known, shares, discount = frequent(counts, n, most)
    often, tag = spark.sparkContext.broadcast(known), uuid.uuid4().hex

    def prepare(batches):
        helpers = seeded(tag, often)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
        names = ["doc_id", "held_out", "n_tokens", "n_often", "often_sum", "rare", "which", "levels", "ids"]
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in parts_of(batch.column(1)):
                values = [ids[lo:hi], held[lo:hi], *prepared(batch.column(1).slice(lo, hi - lo), *helpers)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_often long, often_sum double, rare array<binary>, which binary, levels binary, ids binary"
    held = written(docs.select("doc_id", "text", "held_out").mapInArrow(prepare, schema))
    learned = held.where(~F.col("held_out"))
    stats = Statistics(counts, n, shares, neighbours(learned), classes)
    model = spark.sparkContext.broadcast((stats, *train(learned, stats, rounds)))

    def judge(batches):
        unseeded()
        stats, flat, goes_on = model.value
        w = split(flat, len(stats.prior))
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                blobs, levels, which = (part.column(i).to_pylist() for i in (0, 1, 3))
                score, known, other, edges = judged(blobs, levels, stats, w, goes_on, shares)
                lists = [pa.ListArray.from_arrays(pa.array(edges), x) for x in (picked(part.column(2), which), pa.array(known), pa.array(other))]
                yield pa.RecordBatch.from_arrays([*part.columns[4:], pa.array(score), *lists], names=["doc_id", "held_out", "n_tokens", "n_often", "often_sum", "often_score", "rare", "known", "other"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_often long, often_sum double, often_score double, rare array<binary>, known array<double>, other array<double>"
    part = held.select("ids", "levels", "rare", "which", "doc_id", "held_out", "n_tokens", "n_often", "often_sum").mapInArrow(judge, schema)
    first = written(part.withColumn("row", F.monotonically_increasing_id()))
    drop_written(held)
    rare = first.select("row", F.explode(F.arrays_zip("rare", "known", "other")).alias("x")).select("row", F.col("x.rare").alias("token"), "x.known", "x.other")
    share = F.greatest(F.pow(F.lit(2.0), (level_of("c") - 1) / SCALE) - F.lit(float(discount)), F.lit(0.0)) / F.lit(float(max(n, 1)))
    by_share = F.log(share) + F.col("known")
    both = F.greatest(by_share, "other") + F.log1p(F.exp(-F.abs(by_share - F.col("other"))))
    more = rare.join(counts.select("token", "c"), "token", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.count("c").alias("n_rare"), F.sum(F.when(share > 0, both).otherwise(F.col("other"))).alias("rare_score"),
    )
    every_token = math.log10(n + 0.5 * (v + 1))
    return first.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("often_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(every_token)).alias("base_score"),
        ((F.col("often_score") + F.coalesce("rare_score", F.lit(0.0))) / math.log(10)).alias("score"),
    )
