"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.sources.tables import read_table

from . import katz, langid, lexical, mixing, near_dedup, packing, quality_model, quality_rules, sharding, token_store, top_k, vector_dedup, whitening


QUALITY_CUT = 0.7


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_store.read_tokens(spark, token_store.write_tokens(docs, tokenizer("byte_bpe_50k.json")))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=24)


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.schedule(read_table(spark, sf_dir, "documents"))
    return planned.select(F.col("m_doc").alias("doc_id"), F.col("m_source").alias("source"), F.col("m_bytes").alias("bytes"), "block", "release", "deadline", "slot", "on_target")


def op4_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("row.doc_id", *quality_rules.BASE, "base_failed", "kept")


def op5_minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ["doc_id"])
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id, (quality_model.fold(doc_id, 4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_language_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read_table(spark, sf_dir, "documents"))


def op9_graph_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_copies(read_table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048)


def op11_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op12_shared_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


def op13_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_certified_rules": op4_certified_rules,
    "op5_minhash_near_copies": op5_minhash_near_copies,
    "op6_quality_network": op6_quality_network,
    "op7_language_field": op7_language_field,
    "op8_katz_backoff": op8_katz_backoff,
    "op9_graph_vector_copies": op9_graph_vector_copies,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_histogram_top_k": op11_histogram_top_k,
    "op12_shared_lexical_search": op12_shared_lexical_search,
    "op13_sliced_whitening": op13_sliced_whitening,
}

ORACLE: dict[str, str] = {
    "op11_histogram_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op12_shared_lexical_search": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM docs),
wanted AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), held AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS wt
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), totals
), parts AS (
  SELECT i.item_id, h.doc_id, i.times * wt * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * h.n * nd) // l))) AS part
  FROM wanted i JOIN held h ON i.term = h.term JOIN weights k ON k.term = i.term, totals
), sums AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM sums WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
