"""Registered queries of the subpackage: each reads whole tables and returns its operator's full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortgraph.llm import chat_format, exact_dedup, line_dedup, merkle_manifest, ngram_join, packing, pii, quality_rules, source_mixing, spelling_groups, url_filter, wavelet_shards, weak_quality
from cohortgraph.llm.shared import new_path
from cohortgraph.llm.tokens import vocabulary


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, 85 %: the contract of the query. The operator's own defaults are five words and 80 %."""
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages without a target get nothing: the contract of the query. By the operator's default they get a tempered share."""
    return source_mixing.mix_sources(read(spark, sf_dir, "documents"), rest=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), digest=True)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and answers from the files."""
    path = new_path(spark, "shards")
    wavelet_shards.write_shards(read(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return wavelet_shards.documents_of(wavelet_shards.read_shards(spark, path), digest=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling_groups.word_counts(read(spark, sf_dir, "documents"), drop_every=199)
    return spelling_groups.spelling_forms(counts).select("word", "form", "root", "n", "n_near", "form_n")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)], "conv_id long, turn long, role string, text string")
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.chat_digest(chat_format.format_chats(chats.union(probe)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = merkle_manifest.manifest(read(spark, sf_dir, "documents"), tamper=merkle_manifest.tampered())
    return merkle_manifest.proofs(held).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_rules, op3_best_fit_packing, op4_source_mixing, op5_line_dedup, op6_url_filters, op7_token_output, op8_exact_dedup, op9_weak_quality, op10_pii, op11_spelling_groups, op12_chat_formatting, op13_merkle_manifest)}
ORACLE = {"op1_ngram_jaccard": ngram_join.SQL, "op4_source_mixing": source_mixing.SQL, "op5_line_dedup": line_dedup.SQL, "op6_url_filters": url_filter.SQL, "op8_exact_dedup": exact_dedup.SQL, "op11_spelling_groups": spelling_groups.SQL, "op12_chat_formatting": chat_format.SQL, "op13_merkle_manifest": merkle_manifest.SQL}
