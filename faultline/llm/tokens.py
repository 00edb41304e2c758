"""Subword ids of whole texts inside Spark tasks, with a bounded memo of words."""

from __future__ import annotations

import ctypes
import gc
import os
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that a worker keeps from batch to batch; a word beyond it is encoded again in the next batch.
MEMO_ENTRIES = 600_000

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_MEMOS: dict[tuple, "WordIds"] = {}


class WordIds:
    """Little-endian ids of white-space separated words.

    The pre-tokenizers of these vocabularies never look across ASCII white space, so the ids
    of a text are those of its words, one after the other. Words of letters only are one
    pre-token each, and punctuation at the end of a word is another. So letters are encoded many words
    at once and cut apart where a token ends (or, with a prefix of one space, begins) a word, and
    punctuation once for each kind. With fold, ASCII letters are lower-cased first.
    """

    def __init__(self, path: str, dtype: str, prefix: str = "", ordinary: bool = False, fold: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if ordinary:
            self.tokenizer.encode_special_tokens = True
        self.dtype, self.prefix, self.fold, self.memo = np.dtype(dtype), prefix, fold, {}
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if prefix else t.endswith("</w>"))]] = True

    def each(self, words: list[str], prefix: str | None = None) -> list[bytes]:
        prefix = self.prefix if prefix is None else prefix
        coded = self.tokenizer.encode_batch_fast([prefix + w for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in coded]

    def together(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only."""
        out: list[bytes] = []
        for at in range(0, len(words), 200):
            part = words[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([self.prefix + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.edge[ids])
            cuts = np.append(cuts[1:], len(ids)) if self.prefix else cuts + 1
            if len(cuts) != len(part):
                out += self.each(part)
                continue
            blob, lo = ids.tobytes(), 0
            for hi in (cuts * self.dtype.itemsize).tolist():
                out.append(blob[lo:hi])
                lo = hi
        return out

    def looked_up(self, words: list[bytes], held=None) -> dict[bytes, bytes]:
        """Ids of new words. held: gives the ids of a word known elsewhere, or None; asked for words without the punctuation at their ends."""
        numbers: dict[bytes, int] = {}
        simple: list[tuple[bytes, int, bytes]] = []
        other: list[bytes] = []
        for w in words:
            low = w.lower() if self.fold else w
            core = low.rstrip(_MARKS)
            if core.decode().isalpha():
                simple.append((w, numbers.setdefault(core, len(numbers)), low[len(core) :]))
            else:
                other.append(w)
        out = dict(zip(other, self.each([w.decode() for w in other])))
        tails = {t for _, _, t in simple if t}
        known = dict(zip(tails, self.each([t.decode() for t in tails], "")))
        ids = list(map(held, numbers)) if held else [None] * len(numbers)
        gaps = [i for i, v in enumerate(ids) if v is None]
        cores = list(numbers)
        for i, v in zip(gaps, self.together([cores[i].decode() for i in gaps])):
            ids[i] = v
        for w, k, tail in simple:
            out[w] = ids[k] + known[tail] if tail else ids[k]
        return out

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """For each text, given as its words: the bytes of its ids."""
        ids = iter(self.each_of([w for words in texts for w in words]))
        return [b"".join(islice(ids, len(words))) for words in texts]

    def of_column(self, texts: pa.Array) -> list[bytes]:
        """For each text: the bytes of its ids (null: none). Arrow splits the texts and numbers their words, so each distinct word is looked up once."""
        texts = texts.fill_null("")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.fold else texts)
        codes = lists.flatten().dictionary_encode()
        blobs = self.each_of(codes.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.array([len(b) for b in blobs], np.int64) // self.dtype.itemsize
        word = codes.indices.to_numpy()
        pool, n = np.frombuffer(b"".join(blobs), self.dtype), sizes[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[word] - ends[:-1], n)]
        edges = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])]

    def each_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word of a list."""
        found = list(map(self.memo.get, words))
        gaps = [i for i, v in enumerate(found) if v is None]
        new = self.looked_up(list({words[i] for i in gaps}))
        for i in gaps:
            found[i] = new[words[i]]
        if (room := MEMO_ENTRIES - len(self.memo)) > 0:
            self.memo.update(islice(new.items(), room))
        return found


def in_parts(texts: list, size: int = 2_000_000):
    """(start, end) of runs of texts with about ``size`` characters, so that a batch is never held as words at once."""
    return in_runs([len(t or "") for t in texts], size)


def in_runs(sizes: list[int], size: int = 2_000_000):
    """(start, end) of runs of about ``size`` in sum."""
    start, held = 0, 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= size or i == len(sizes):
            yield start, i
            start, held = i, 0


def word_ids(path: str, dtype: str = "<u4", prefix: str = "", ordinary: bool = False, fold: bool = False) -> WordIds:
    """The worker's own instance; reused by later tasks of the same worker."""
    key = (path, dtype, prefix, ordinary, fold)
    if key not in _MEMOS:
        _MEMOS[key] = WordIds(*key)
    return _MEMOS[key]


def forget() -> None:
    """Give the memory of vocabularies, memos and past tasks back to the system: a worker outlives its stage, and the next one needs none of it.

    malloc keeps freed memory unless asked; only glibc has the call.
    """
    _MEMOS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
