"""The queries opN_<name>: thin applications of the operators to whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.llm import (
    conversation_trie, decontaminate, html_text, hyper_minhash, license_scan, mixing, ngram_join, permutation_index, quality, secret_scan, source_audit, sql, substring, suffixes,
)
from brightline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component that five-word shingle similarity of 0.8 or more puts it in."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark windows found in it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontaminate.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents, by place and digest."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that repeat runs of 20 words from earlier."""
    return substring.dedup_phrases(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in the documents."""
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes that strings of 200 bytes which occur again cover."""
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps, with their log weights and keys."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.resample(docs.select("doc_id", "text"), model).select("doc_id", "log_weight", "key")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the terms of every source differ from each other source of its language, and from the language."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component that four-word shingle similarity of 0.8 or more puts it in."""
    return hyper_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, each with turns lent by the first of its family."""
    return conversation_trie.trie(conversation_trie.paths(table(spark, sf_dir, "conversations"), conversation_trie.lent_turns))


def queries() -> dict[str, Query]:
    return {
        "op1_permutation_index": op1_permutation_index,
        "op2_ngram_join": op2_ngram_join,
        "op3_decontaminate": op3_decontaminate,
        "op4_secret_scan": op4_secret_scan,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_html_text": op6_html_text,
        "op7_mixing": op7_mixing,
        "op8_license_scan": op8_license_scan,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality": op10_quality,
        "op11_source_audit": op11_source_audit,
        "op12_hyper_minhash": op12_hyper_minhash,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the result; the other operators rest on hashes, suffix arrays or fitted models."""
    return {
        "op2_ngram_join": sql.OP2, "op3_decontaminate": sql.OP3, "op5_substring_dedup": sql.OP5, "op7_mixing": sql.OP7, "op9_suffix_dedup": sql.OP9,
        "op11_source_audit": sql.OP11, "op12_hyper_minhash": sql.OP12, "op13_conversation_trie": sql.OP13,
    }
