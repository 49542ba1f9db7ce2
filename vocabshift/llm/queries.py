"""Registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocabshift.llm import decontam, html_main, infill, langid, ngram_join, pii, prefix_trie, repeats, reshard, secret_scan, subword, topk, toxicity
from vocabshift.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.report(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best inner products of every fiftieth vector."""
    return topk.report(read_table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(pii.personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_join.report(read_table(spark, sf_dir, "documents"))


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New shard and slot of every document."""
    return reshard.report(read_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.report(secret_scan.secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword ids of every document."""
    return subword.report(read_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    documents = read_table(spark, sf_dir, "documents")
    return decontam.report(decontam.contamination(documents, read_table(spark, sf_dir, "benchmark")))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.report(read_table(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of an earlier one."""
    return repeats.report(repeats.without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document."""
    return infill.report(infill.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie.report(prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_pii": op4_pii,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_reshard": op6_reshard,
    "op7_secrets": op7_secrets,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_html_main_text": op10_html_main_text,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op3_exact_top_k": topk.ORACLE,
    "op5_ngram_jaccard_join": ngram_join.ORACLE,
    "op9_benchmark_decontamination": decontam.ORACLE,
    "op11_substring_dedup": repeats.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
