"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
from pyspark.sql.window import Window

from .common import small_batches
from .tokens import forget

#: Labelled documents per language whose texts make its dictionary, and the bytes kept of them.
SAMPLE_DOCS = 200
DICTIONARY_BYTES = 16 * 1024
#: Texts are compressed in blocks of this many bytes, so that the dictionary matters throughout.
BLOCK_BYTES = 2048
#: Compression levels in the order tried: the next one is asked where the margin stays narrow (short texts that one level stores as they are).
#: Level 12 takes about twice the time of level 10 and tells no more held-out languages (measured on four tables), so it comes last.
LEVELS = (10, 6, 3, 12)
#: Least relative saving of the best language over the second.
MARGIN = 0.02

_OTHER = re.compile(r"[\W\d_]+")


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null lang of (doc_id, text, lang).

    The classifier is fitted on a bounded sample: of each language the ``sample_docs``
    documents of least hashed doc_id, from which equal shares of at most ``size`` bytes in
    all are taken. The choice uses ids only, in two steps, so no language gathers in one task. Of rows that repeat
    lang and doc_id the least text is taken, so that the bound holds; rows without doc_id teach nothing.
    """
    ids = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    part = ids.withColumn("part", F.pmod("h", F.lit(8)))
    order = [F.col("h"), F.col("doc_id")]
    some = part.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("k") <= sample_docs)
    best = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= sample_docs)
    chosen = best.select("doc_id", "lang").distinct()
    share = max(1, size // sample_docs)
    # each text gives what its share of the size takes, eight characters a byte at most
    room = F.greatest(F.lit(share), F.floor(F.lit(size) / F.count("*").over(Window.partitionBy("lang")))) * 8
    chosen = F.broadcast(chosen.withColumn("room", room.cast("int")))  # at most sample_docs rows a language
    rows = labelled.join(chosen, ["doc_id", "lang"]).select("lang", "doc_id", F.substring("text", F.lit(1), F.col("room")).alias("text"))
    rows = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] or 0, r["text"] or "")):
        by.setdefault(r["lang"], []).append(normal(r["text"] or ""))
    for lang, texts in by.items():
        each = max(share, size // max(1, len(texts)))
        out[lang] = b" ".join(cut(t, each) for t in texts)[-size:] or b" "
    return out


def cut(text: bytes, size: int) -> bytes:
    """At most ``size`` bytes of the text, ending at a space where there is one."""
    return text if len(text) <= size else text[:size].rpartition(b" ")[0] or text[:size]


def normal(text: str) -> bytes:
    """Lower-case letters, with one space for each run of anything else."""
    return _OTHER.sub(" ", text.lower()).encode()


def classify(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN, block: int = BLOCK_BYTES, levels: tuple = LEVELS) -> DataFrame:
    """docs plus lang_pred, score (0 to 1) and rejected.

    Every block of the whole text is compressed with each language's dictionary; the
    smallest total wins, ties go to the first language by name. score is the relative saving
    of the best over the second, mapped to 0..1 (0.5 at the margin). rejected: the saving is below the margin, or no letter.
    Null text or text without a letter: lang_pred "und", score 0. With nothing
    learned every row is "und". Only the text is looked at; other columns pass through,
    and a column already named like an output is replaced.
    """
    small_batches(docs.sparkSession)
    names = sorted(learned)
    out = ["lang_pred", "score", "rejected"]
    kept = docs.drop(*out)
    at = kept.columns.index("text")
    schema = StructType(list(kept.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())

    def run(batches):
        import zstandard

        forget()

        def coder(name: str, level: int):
            d = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

        coders = [[coder(n, level) for n in names] for level in levels]

        def best_of(parts: list[bytes], with_: list) -> tuple[float, int]:
            """Relative saving of the smallest total over the second, and whose it is."""
            sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in with_], float)
            second = np.partition(sizes, 1)[1]
            return (second - sizes.min()) / second, int(sizes.argmin())

        def judge(text: str | None) -> tuple[str, float, bool]:
            if not text or not names or not any(map(str.isalpha, text)):
                return "und", 0.0, True
            data = normal(text)
            parts = [data[i : i + block] for i in range(0, len(data), block)]
            if len(names) == 1:
                return names[0], 1.0, False
            saving, best = 0.0, 0
            for with_ in coders:
                now = best_of(parts, with_)
                if now[0] > saving:
                    saving, best = now
                if saving >= margin:
                    break
            return names[best], float(saving / (saving + margin)), bool(saving < margin)

        for batch in batches:
            rows = list(zip(*map(judge, batch.column(at).to_pylist()))) or [[], [], []]
            added = [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *out])

    return kept.mapInArrow(run, schema)
