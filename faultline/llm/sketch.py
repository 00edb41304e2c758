"""Document fingerprints: bottom-k sketches of shingle hashes, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, shuffle_width, words, written

K = 128
SHINGLE = 5
_SPAN = float(1 << 64)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, shingle: int = SHINGLE) -> Column:
    """Distinct hashes of the runs of ``shingle`` words, in ascending order; fewer words: of the whole sequence."""
    n = F.size(hashes)
    starts = F.sequence(F.lit(0), n - shingle)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(shingle)]))
    short = F.array(F.xxhash64(F.array_join(F.transform(hashes, lambda h: h.cast("string")), " ")))
    return F.sort_array(F.array_distinct(F.when(n >= shingle, runs).when(n > 0, short).otherwise(F.slice(short, 1, 0))))


def sketch(hashes: Column, k: int = K) -> Column:
    """The k least shingle hashes of a column of word hashes."""
    return F.slice(shingle_hashes(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union: sketches of parts merge to the sketch of the whole."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles of the union (1 for two empty sketches)."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    top = F.element_at(a, -1).cast("double") + _SPAN / 2
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(k) - 1) / (top / _SPAN))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds (1 for an empty a)."""
    union = merge(a, b, k)
    common = resemblance(a, b, k) * distinct_count(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(distinct_count(a, k), F.lit(1.0))))


def merged_by(sketches: DataFrame, by: str, column: str = "sketch", k: int = K) -> DataFrame:
    """(by, column): one sketch for each group of rows.

    Groups are merged in two steps of ranked distinct hashes, first within salted parts, so
    that a group with a third of the rows is reduced in many tasks.
    """
    salts = 4 * shuffle_width(sketches.sparkSession)
    flat = sketches.select(by, F.explode(column).alias("h")).withColumn("salt", F.pmod("h", F.lit(salts)))
    some = flat.distinct().withColumn("r", F.row_number().over(Window.partitionBy(by, "salt").orderBy("h"))).where(F.col("r") <= k)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("h"))).where(F.col("r") <= k)
    return best.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias(column))


def fingerprint(sketched: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def followed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) plus next_text: the text of the next row by descending doc_id, after the last the first.

    Rows are dealt to ranges of doc_id with about equal counts; within each the next row is
    a window offset, between ranges the first row of the next one that has rows. Null doc_ids come last, repeated
    doc_ids follow the order of their text hashes.
    """
    n = shuffle_width(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("version", F.xxhash64("text"))
    cuts = d.agg(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]), F.lit(10000))).first()[0] if n > 1 else None
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket_of(F.col("doc_id"), sorted(set(cuts or []))))
    dealt = d.withColumn("part", part)
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("version"))
    inside = dealt.withColumns({"follower": F.lead("text").over(order), "inner": F.lead(F.lit(True)).over(order)})
    heads = written(dealt.groupBy("part").agg(F.max(F.struct("doc_id", "version")).alias("head")))  # one row for each range
    ring = Window.partitionBy(F.lit(0)).orderBy(F.desc("part"))
    first = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = heads.select("part", F.coalesce(F.lead("head").over(ring), first).alias("head"))
    ends = ends.select("part", F.col("head.doc_id").alias("doc_id"), F.col("head.version").alias("version"))
    held = d.alias("d").join(F.broadcast(ends.alias("e")), F.expr("d.doc_id <=> e.doc_id and d.version = e.version"))
    edges = held.select("e.part", F.col("d.text").alias("first_text")).dropDuplicates(["part"])
    next_text = F.when(F.col("inner"), F.col("follower")).otherwise(F.col("first_text"))
    return inside.join(edges, "part", "left").select("doc_id", "text", next_text.alias("next_text"), "part", "version", F.coalesce("inner", F.lit(False)).alias("inner"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def edit_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited and near_next for every row.

    The edited text takes its second half from the next document. Null text: empty, with
    an empty sketch; a text shorter than a shingle has one hash; a single row is its own next
    document. Repeated rows are rows like any other. Empty table: no rows. Columns of docs other than doc_id
    and text are ignored.
    """
    changed = followed(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    hashed = changed.select(
        "doc_id", "part", "version", "inner", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        word_hashes(F.col("text")).alias("w"), word_hashes(F.col("edit")).alias("e"), F.when(~F.col("inner"), word_hashes(F.col("next_text"))).alias("f"),
    )
    own = hashed.select(
        "doc_id", "part", "version", "inner", "n_chars", "edited_sha256",
        sketch(F.col("w"), k).alias("sketch"), sketch(F.col("e"), k).alias("edited_sketch"), F.when(~F.col("inner"), sketch(F.col("f"), k)).alias("first_sketch"),
    )
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("version"))
    beside = own.withColumn("next_sketch", F.coalesce(F.lead("sketch").over(order), "first_sketch"))
    near = lambda c: resemblance(F.col("sketch"), F.col(c), k)
    return beside.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", near("edited_sketch").alias("near_edited"), near("next_sketch").alias("near_next"))
