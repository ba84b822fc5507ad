"""The corpus pipeline: five stages over documents, each by one of the text operators.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has
kept.  All but the last return the columns of documents; the last returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.llm import jaccard, op5_decontaminate, op6_simhash, op7_sentencepiece, op8_quality_rules, op10_secret_scan
from taxolens.llm.common import stored, table

#: Vocabulary of the last stage.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The near-duplicate stage takes shingles of five words; texts link at a Jaccard similarity of 0.8 or RADIUS bits.
SHINGLE, RADIUS = 5, op6_simhash.RADIUS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op8_quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts one row stays, the one with the least id (of those, the least text's hash).

    Rows are judged by their text, not by their id: other texts that share an id with a copy stay. Of rows
    with equal id and text one stays. Rows with a null id stay.
    """
    return jaccard.first_of_groups(docs, SHINGLE, RADIUS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return op5_decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced with a mark; n_chars follows the text."""
    return op10_secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless of every document that is left."""
    return op7_sentencepiece.encode(docs, MODEL_FILE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: SQL expresses neither fingerprints nor pieces; the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
