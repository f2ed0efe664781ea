"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bit_sliced, decontaminate, html_text, language_model, lines, oracles, quality, resampling, sentencepiece_fst, simhash, suffix_dedup, tokens, toxicity
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip of every document."""
    import public_tokenizers

    return sentencepiece_fst.encode_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its shard files."""
    import public_tokenizers

    return tokens.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and kept_sha256 of every document."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base counts, base_failed and the adaptive verdict of every document."""
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents")).select(*cols)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base_score and score of every document."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every document."""
    import public_tokenizers

    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 best partners of every vector whose vec_id is divisible by 20."""
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_token_output": op3_token_output,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_html_text": op5_html_text,
        "op6_decontamination": op6_decontamination,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_toxicity": op9_toxicity,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_alignment": op11_alignment,
        "op12_resampling": op12_resampling,
        "op13_exact_top_k": op13_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; tests hold the others against brute force."""
    return {
        "op6_decontamination": oracles.DECONTAMINATION,
        "op7_line_dedup": oracles.LINE_DEDUP,
        "op8_quality_rules": oracles.QUALITY,
        "op12_resampling": oracles.RESAMPLING,
        "op13_exact_top_k": oracles.TOP_K,
    }
