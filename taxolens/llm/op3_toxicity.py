"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of a-z (A-Z lower-cased), digits and everything beyond ASCII.  A
text's features are the presence of hashed single words, pairs of neighbours and
pairs with one word between.  Per-coordinate rates and a strong L1 term leave few
non-zero weights; only those are broadcast.  A score looks up every feature of
the whole text and adds each present one once.

Null and empty texts have no feature and get the bias alone.  Repeated rows and
ties are scored alike, each on its own; a table without labels gives score 0.5.
Ids are of any type. A text is never split over workers: one takes some 150 times
the bytes of its longest text, or of a chunk of 1 MiB.  Only ids and texts are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from taxolens.llm import linear
from taxolens.llm.ftrl import Ftrl
from taxolens.llm.textkit import ALNUM, LOWER, ngrams, row_of, runs, span_hashes

#: At most so many labelled rows are learnt from, chosen by hash of the id.
MAX_TRAIN = 12_000
THRESHOLD = 0.3
#: Chosen on thirds of the rows that may be learnt from: a row of label 1 counts twice, as one in nine has it.
FTRL = Ftrl(bits=20, alpha=2.0, l1=12.0, l2=0.1, epochs=3, min_updates=8_000, positive=2.0)


def raw_features(data: np.ndarray, offsets: np.ndarray, bits: int = FTRL.bits) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and skip-pairs: feature indexes, and where each text's begin."""
    data = LOWER[data]
    starts, ends, ptr = runs(ALNUM[data], offsets)
    words = span_hashes(data, starts, ends)
    return [((h >> np.uint64(64 - bits)).astype(np.int64), at) for h, at in (ngrams(words, ptr, 1), ngrams(words, ptr, 2), ngrams(words, ptr, 2, skip=1))]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([(row_of(at) << FTRL.bits) + idx for idx, at in raw_features(data, offsets)]))
    return key >> FTRL.bits, key & ((1 << FTRL.bits) - 1), np.ones(len(key))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_TRAIN) -> np.ndarray:
    return linear.fit(docs, labels, doc_id, text, label, features, FTRL, limit)


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    used = np.flatnonzero(weights[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], float(weights[-1]), len(weights) - 1))
    tables: list[np.ndarray] = []

    def margin(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        used, w, bias, size = shared.value
        if not tables:
            tables.append(np.zeros(size, bool))
            tables[0][used] = True
        hits = []
        for idx, at in raw_features(data, offsets):
            here = np.flatnonzero(tables[0][idx])
            hits.append(((np.searchsorted(at, here, side="right") - 1) << FTRL.bits) + idx[here])
        key = np.unique(np.concatenate(hits))
        value = w[np.searchsorted(used, key & ((1 << FTRL.bits) - 1))] if len(key) else np.zeros(0)
        return np.bincount(key >> FTRL.bits, weights=value, minlength=len(offsets) - 1) + bias

    return linear.apply(docs, doc_id, text, margin)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model fitted on the labels that aren't held out."""
    return linear.verdicts(score(docs, fit(docs, labels, doc_id, text, label), doc_id, text), threshold)
