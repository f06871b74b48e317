"""Registered queries of the operators: name -> job, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repotide.llm.chat import chat_digests, format_conversations, with_probe
from repotide.llm.common import table
from repotide.llm.decontaminate import decontaminate
from repotide.llm.jaccard import jaccard_components
from repotide.llm.language import identify_language
from repotide.llm.licenses import license_report, scan_licenses
from repotide.llm.negatives import hard_negatives, shifted_labels
from repotide.llm.oracles import ORACLES
from repotide.llm.packing import pack_documents
from repotide.llm.pages import extract_pages
from repotide.llm.prefixes import conversation_trie
from repotide.llm.secrets import scan_secrets
from repotide.llm.sharding import even_tree, shard_documents
from repotide.llm.sketches import as_text, fingerprint_documents
from repotide.llm.tokenfile import read_token_digests, write_tokens

SHARDS = 16


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(format_conversations(with_probe(spark, table(spark, sf_dir, "conversations"))))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, table(spark, sf_dir, "documents"))

    def digest(rows: F.Column) -> F.Column:
        return F.array_join(F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["base"])

    def count(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda f: f["base"] & (f["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("findings")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_digests(spark, write_tokens(spark, table(spark, sf_dir, "documents")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), even_tree(SHARDS))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(scan_licenses(spark, table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(shifted_labels(table(spark, sf_dir, "embeddings")), "vec_id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_token_file": op5_token_file,
    "op6_html_text": op6_html_text,
    "op7_sharding": op7_sharding,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_license_scan": op11_license_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
