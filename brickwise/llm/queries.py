"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brickwise.llm.common import table
from brickwise.llm.conversation_trie import conversation_trie, conversation_trie_sql
from brickwise.llm.decontaminate import benchmark_leaks
from brickwise.llm.embedding_dedup import embedding_components
from brickwise.llm.filter_audit import filter_audit_sql, filter_interactions
from brickwise.llm.license_scan import license_scan, license_sql
from brickwise.llm.packing import packed
from brickwise.llm.quality import quality
from brickwise.llm.secret_scan import secret_scan, secret_sql
from brickwise.llm.sentencepiece_scan import encode_documents
from brickwise.llm.simhash_dedup import simhash_components
from brickwise.llm.substring_dedup import substring_dedup
from brickwise.llm.token_counts import token_counts
from brickwise.llm.toxicity import toxicity


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_sentencepiece, op3_substring_dedup, op4_license_scan, op5_secret_scan, op6_quality, op7_token_counts, op8_embedding_dedup, op9_toxicity, op10_simhash_dedup, op11_conversation_trie, op12_best_fit_packing, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_sql(), "op5_secret_scan": secret_sql(), "op11_conversation_trie": conversation_trie_sql(), "op13_filter_audit": filter_audit_sql()}
