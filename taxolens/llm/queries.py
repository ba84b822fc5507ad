"""The text operators' queries over the provided tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxolens.llm import (
    op1_substring_dedup,
    op2_quality_classifier,
    op3_toxicity,
    op4_url_filters,
    op5_decontaminate,
    op6_simhash,
    op7_sentencepiece,
    op8_quality_rules,
    op9_chat_format,
    op10_secret_scan,
    op11_token_counts,
    op12_ranked_search,
    op13_conversation_repair,
)
from taxolens.llm.common import table


#: Vocabulary of the encoding query.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_substring_dedup.repeats(table(spark, sf_dir, "documents")).drop("text_key")


def op2_quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_url_filters.judge(table(spark, sf_dir, "pages"))


def op5_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sentencepiece.encode(table(spark, sf_dir, "documents"), MODEL_FILE)


def op8_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = op8_quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_chat_format.digests(op9_chat_format.with_probe(table(spark, sf_dir, "conversations")))


def op10_secret_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secret_scan.report(table(spark, sf_dir, "documents"))


def op11_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op11_token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_ranked_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_conversation_repair.report(op13_conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup_query,
    "op2_quality_classifier": op2_quality_classifier_query,
    "op3_toxicity": op3_toxicity_query,
    "op4_url_filters": op4_url_filters_query,
    "op5_decontaminate": op5_decontaminate_query,
    "op6_simhash": op6_simhash_query,
    "op7_sentencepiece": op7_sentencepiece_query,
    "op8_quality_rules": op8_quality_rules_query,
    "op9_chat_format": op9_chat_format_query,
    "op10_secret_scan": op10_secret_scan_query,
    "op11_token_counts": op11_token_counts_query,
    "op12_ranked_search": op12_ranked_search_query,
    "op13_conversation_repair": op13_conversation_repair_query,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op4_url_filters": op4_url_filters.oracle_sql,
    "op5_decontaminate": op5_decontaminate.oracle_sql,
    "op8_quality_rules": op8_quality_rules.oracle_sql,
    "op9_chat_format": op9_chat_format.oracle_sql,
    "op10_secret_scan": op10_secret_scan.oracle_sql,
    "op12_ranked_search": op12_ranked_search.oracle_sql,
    "op13_conversation_repair": op13_conversation_repair.oracle_sql,
}
