"""Fitting and applying sparse linear text models over DataFrames.

A feature function turns a chunk of texts into (text of each feature, feature
index, value).  Models are fitted on the driver from a bounded, documented
sample of labelled rows and applied on the executors as sparse dot products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.llm.common import bound_batches, stored
from taxolens.llm.ftrl import Ftrl, logistic
from taxolens.llm.textkit import text_chunks

#: At most so many features of labelled rows are gathered (8 bytes each), those of the first rows by hash of the id.
MAX_FEATURES = 20_000_000

#: (bytes, offsets) -> text of each feature (sorted), index, value; each (text, index) once.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def remainder(doc_id: str):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def labelled_sample(labels: DataFrame, doc_id: str, label: str, limit: int) -> DataFrame:
    """At most `limit` rows (doc_id, label) that may be learnt from, chosen by hash of the id.

    Rows whose remainder is 2 are held out; null ids and null labels are left out; of several labels
    of one id the largest counts.
    """
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
    usable = usable.where(remainder("doc_id") != 2).groupBy("doc_id").agg(F.max("label").alias("label"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def collect_features(docs: DataFrame, sample: DataFrame, doc_id: str, text: str, features: Features) -> tuple[list, np.ndarray]:
    """Feature rows and labels of the sample's documents, in order of the id.

    The sample is bounded, so it is broadcast, and so are the features (MAX_FEATURES), so they fit the
    driver however long the texts are.  Of several texts with one id the one with the smallest hash counts.
    """
    bound_batches(docs.sparkSession)
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                row, idx, val = features(data, offsets)
                ptr = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("label").slice(lo, hi - lo),
                        batch.column("tie").slice(lo, hi - lo),
                        pa.array([idx[ptr[i] : ptr[i + 1]].astype("<i4").tobytes() for i in range(hi - lo)], pa.binary()),
                        pa.array([val[ptr[i] : ptr[i + 1]].astype("<f4").tobytes() for i in range(hi - lo)], pa.binary()),
                    ],
                    ["doc_id", "label", "tie", "idx", "val"],
                )

    rows = pairs.select("doc_id", F.col("label").cast("int").alias("label"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.mapInArrow(extract, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, tie bigint, idx binary, val binary")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "idx", "val"), "tie").alias("x")).select("doc_id", "x.*")
    rows = stored(rows, "features")
    so_far = F.sum(F.length("idx") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= MAX_FEATURES).select("doc_id")
    rows = rows.join(F.broadcast(kept), "doc_id", "left_semi")
    got = rows.toArrow().combine_chunks().sort_by("doc_id")
    pick = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) if x.as_buffer().size else np.zeros(0, kind) for x in got[name]]
    return list(zip(pick("idx", "<i4"), pick("val", "<f4"), strict=True)), got["label"].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, features: Features, ftrl: Ftrl, limit: int) -> np.ndarray:
    """Weights (the last is the bias); all zero where there is nothing to learn from."""
    rows, y = collect_features(docs, labelled_sample(labels, doc_id, label, limit), doc_id, text, features)
    return ftrl.fit(rows, y) if rows else np.zeros((1 << ftrl.bits) + 1)


def apply(docs: DataFrame, doc_id: str, text: str, margin: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row; margin: chunk -> log-odds of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                score = logistic(margin(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(score, pa.float64())], ["doc_id", "score"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted; a null id is not held out."""
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
