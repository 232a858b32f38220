"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, decontam, importance, merkle, minhash_join, mixing, ogg, paragraph_dedup, pii, sharding, toxicity, turns, url_filter
from .common import table

#: Bytes of a shard and of a mixing block.
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(table(spark, sf_dir, "documents"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), block_bytes=BLOCK_BYTES)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot")


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return sharded.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "shard_depth", "shard_bytes", "shard_rows")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "spam_score")


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans found in each document."""
    found = pii.find_spans(docs.select("doc_id", "text"))
    spans = F.col("pii")
    counts = [F.size(pii.of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    scores = F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(pii.listed(pii.of_kinds(spans, *pii.BASE)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"), scores)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digests(turns.repair(turns.damaged(table(spark, sf_dir, "conversations"))))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of documents; the leaf that a tampered text would have is folded with
    the proof of the untampered one. Every row whose id's checksum 5 divides is tampered with."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", UPPER, LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"), F.when(tampered, merkle.leaf(*fields, lowered)).alias("altered"))
    proved = merkle.prove(leaves)
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root")
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_paragraph_minhash, op2_importance_resampling, op3_toxicity, op4_bwt_dedup, op5_ogg, op6_pfair_mixing, op7_minhash_join, op8_spaced_seeds, op9_extendible_sharding, op10_url_filter, op11_pii, op12_conversation_repair, op13_merkle_manifest)}

ORACLE: dict[str, str] = {
    "op7_minhash_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
posted AS (SELECT c, n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM posted a JOIN posted b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
least_of AS (SELECT a AS c, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least_of USING (c)""",
    "op9_extendible_sharding": f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
p AS (SELECT doc_id, n_bytes, bits, depth, substr(bits, 1, depth) AS shard FROM (SELECT *, unnest(range(0, 61)) AS depth FROM d)),
buckets AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(bits) = max(bits))
SELECT doc_id, n_bytes, shard, depth::INT AS shard_depth, shard_bytes, shard_rows
FROM p JOIN buckets USING (depth, shard) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
}
