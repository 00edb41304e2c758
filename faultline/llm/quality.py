"""Quality rules by repetition coverage: characters inside repeated n-grams and lines."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import in_parts

#: Most share of a text's word characters inside n-grams that occur twice or more, by n; and inside repeated lines.
COVERAGE = {5: 0.40, 6: 0.36, 7: 0.33, 8: 0.30, 9: 0.29, 10: 0.28}
LINE_COVERAGE = 0.30
#: The base rule: fewest words, window length, most per cent of words in repeated windows.
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
SYMBOLS = "#*$%&|<>"

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\n\x0b\x0c\r"
_ODD = 0x9E3779B97F4A7C15
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_coverage double, gram_coverage array<double>, base_failed boolean, kept boolean"
)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of small integers."""
    x = (x + np.uint64(1)) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes (modulo 2^64) of all windows of a sequence of word ids, for any window length."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        n = len(ids)
        powers = np.full(n + 1, np.uint64(_ODD))
        inverse = np.full(n + 1, np.uint64(pow(_ODD, -1, 1 << 64)))
        powers[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled(ids) * np.multiply.accumulate(powers)[:n], dtype=np.uint64)])
        self.doc, self.mark = doc, scrambled(doc.astype(np.uint64))

    def repeated(self, n: int) -> np.ndarray:
        """For each word: is it in a window of n words that occurs twice or more in its document, overlaps and the first included."""
        size = len(self.doc)
        out = np.zeros(size, bool)
        if size < n:
            return out
        at = np.flatnonzero(self.doc[: size - n + 1] == self.doc[n - 1 :])
        key = (self.sums[at + n] - self.sums[at]) * self.inverse[at] ^ self.mark[at]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(at), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + n, -1)
        return np.cumsum(edge[:size]) > 0


def repeated_lines(text: str) -> tuple[int, int]:
    """How many lines with a word equal an earlier line of the text, and their characters."""
    seen: set[str] = set()
    n = chars = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            if line in seen:
                n += 1
                chars += len(line)
            seen.add(line)
    return n, chars


def measure(docs: DataFrame, coverage: dict[int, float] | None = None, line_coverage: float = LINE_COVERAGE) -> DataFrame:
    """One row for each document with its counts, coverages and verdict.

    kept is false if the base rule fails (fewer than 20 words, or over 30 % of the words in
    repeated 8-word windows), or if the share of word characters inside n-grams that
    occur twice or more exceeds the limit for any n, or that of characters in repeated lines does. Null and
    blank texts have no words and fail. Whole texts are measured, in slices of documents that fit
    in memory; hash equality stands for window equality (64 bits). Columns other than doc_id and text are ignored.
    """
    limits = dict(coverage or COVERAGE)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in in_parts(texts):
                yield judged(ids[lo:hi], [t or "" for t in texts[lo:hi]], limits, line_coverage)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def judged(ids: list, texts: list[str], limits: dict[int, float], line_limit: float) -> pa.RecordBatch:
    found = [_WORD.findall(t) for t in texts]
    n_words = np.array([len(w) for w in found], np.int64)
    flat = list(chain.from_iterable(found))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.uint64, len(flat))
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), n_words)
    per_doc = lambda weights: np.bincount(doc, weights, len(texts)).astype(np.int64)
    rolling = Rolling(words, doc)
    chars = per_doc(lengths)
    base = per_doc(rolling.repeated(WINDOW))
    shares = np.stack([per_doc(lengths * rolling.repeated(n)) for n in limits], 1) / np.maximum(chars, 1)[:, None]
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(-1, 2)
    in_lines = lines[:, 1] / np.maximum(1, [len(t) for t in texts])
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    failed = (n_words < MIN_WORDS) | (100 * base > MAX_REPEATED * n_words)
    kept = ~failed & (shares <= np.array(list(limits.values()))).all(1) & (in_lines <= line_limit)
    columns = [ids, n_words, chars, symbols, lines[:, 0], base, in_lines, list(shares), failed, kept]
    types = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])
