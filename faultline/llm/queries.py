"""The registered queries over the training-data tables; each derives its digest columns from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, mixing, packing, pages, pii, quality, scoring, sharding, simhash, sketch, trie, whitening
from .common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return scoring.score(documents(spark, sf_dir), held_out)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edit_likeness(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", sketch.fingerprint(F.col("sketch")).alias("fingerprint"), sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.round(sketch.distinct_count(F.col("sketch"))).cast("long").alias("n_shingles"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    counts = [count("base", k) for k in range(pii.BASE)] + [count("spans", k) for k in range(pii.BASE, len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), report=True)
    return found.select("doc_id", "n_lines", F.size("doomed").cast("long").alias("n_removed"), F.array_join("doomed", ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(documents(spark, sf_dir)).drop("gram_coverage")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    learned = language.dictionaries(docs.where(~F.coalesce(held_out, F.lit(False))))
    found = language.classify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("head_id"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return trie.prefix_trie(both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector")))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_scoring": op2_scoring,
    "op3_simhash": op3_simhash,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_extraction": op13_extraction,
}

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, turn, substr(sha256(sha256(coalesce(role, '')) || coalesce(text, '')), 1, 32) AS digest, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, conv_id::VARCHAR AS s, list({{'digest': digest, 'size': size}} ORDER BY turn NULLS FIRST, digest) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT *, ({_CRC} % 6)::INT AS h FROM own
), r AS (
  SELECT h.conv_id, CASE WHEN b.turns IS NULL THEN [] ELSE list_slice(b.turns, 1, h.h) END || list_slice(h.turns, h.h + 1, len(h.turns)) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (
  SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns, array_to_string(list_transform(turns, lambda x: x.digest), '') AS whole FROM r
), m AS (
  SELECT conv_id, n, depth, substr(whole, 1, (32 * depth)::INT) AS node, CASE WHEN depth = 0 THEN 0 ELSE turns[depth].size END AS size FROM p
), node AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth
), kids AS (
  SELECT substr(node, 1, (32 * (depth - 1))::INT) AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), up AS (
  SELECT node.node, size, n_convs, kids.node IS NULL AS leaf, unnest(range(0, depth + 1)) AS upto FROM node LEFT JOIN kids USING (node)
), sub AS (
  SELECT substr(node, 1, (32 * upto)::INT) AS node, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM up GROUP BY 1
)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children, sub.n_leaves, sub.saved_tokens, node.ends_sha256
FROM node JOIN sub USING (node) LEFT JOIN kids USING (node) LEFT JOIN node parent ON node.depth > 0 AND parent.node = substr(node.node, 1, (32 * (node.depth - 1))::INT)
""",
}
