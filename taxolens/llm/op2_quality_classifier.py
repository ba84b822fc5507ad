"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader.

Tokens are runs of letters and digits, runs of other signs, and line ends.  A
text's features are hashed 1- and 2-grams of tokens, and 1- to 3-grams of tokens
in which each word is replaced with its shape (lower, capitalised, upper, with a
digit; equal to the word before it or not), so that the model also sees the form
of words it never met.  A feature's value is ten times its share of all n-grams,
so a score is one gather and one mean over the text, and doesn't need counts.

Null and empty texts have no feature and get the bias alone.  Repeated rows and
ties are scored alike, each on its own; a table without labels gives score 0.5.
Ids are of any type. A text is never split over workers: one takes some 200 times
the bytes of its longest text, or of a chunk of 1 MiB.  Only ids and texts are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from taxolens.llm import linear
from taxolens.llm.ftrl import Ftrl
from taxolens.llm.textkit import LOWER, NOT_SPACE, byte_class, mix, ngrams, row_of, runs, span_hashes

#: At most so many labelled rows are learnt from, chosen by hash of the id.
MAX_TRAIN = 6_000
THRESHOLD = 0.7
FTRL = Ftrl(bits=18, alpha=1.0, l1=0.0, l2=0.1, epochs=4, min_updates=12_000)
SCALE = 10.0

_WORD = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_UPPER, _DIGIT = byte_class(range(0x41, 0x5B)), byte_class(range(0x30, 0x3A))
_KIND = np.where(_WORD, 1, np.where(NOT_SPACE, 2, 0)).astype(np.uint8)
_KIND[ord("\n")] = 3


def raw_features(data: np.ndarray, offsets: np.ndarray, bits: int = FTRL.bits) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature index) of every n-gram occurrence of a chunk."""
    kind = _KIND[data]
    found = [(*runs(kind == k, offsets)[:2], k) for k in (1, 2, 3)]
    starts, ends = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    which = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    order = np.argsort(starts, kind="stable")
    starts, ends, which = starts[order], ends[order], which[order]
    ptr = np.searchsorted(starts, offsets)
    tokens = span_hashes(data, starts, ends)
    total = lambda table: np.concatenate(([0], np.cumsum(table[data])))
    upper, digit = (c[ends] - c[starts] for c in (total(_UPPER), total(_DIGIT)))
    shape = (upper > 0).astype(np.int64)
    shape[(upper >= 2) & (2 * upper > ends - starts)] = 2
    shape[digit > 0] = 3
    words = np.flatnonzero(which == 1)
    folded = span_hashes(LOWER[data], starts[words], ends[words])
    again = (folded[1:] == folded[:-1]) & (row_of(ptr)[words[1:]] == row_of(ptr)[words[:-1]])
    shape[words[1:][again]] += 8
    shapes = np.where(which == 1, mix(shape.astype(np.uint64) + np.uint64(77)), tokens)
    rows, keys = [], []
    for salt, source, n in ((0, tokens, 1), (0, tokens, 2), (1, shapes, 1), (1, shapes, 2), (1, shapes, 3)):
        h, at = ngrams(source, ptr, n)
        keys.append(((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
        rows.append(row_of(at))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, feature) once, with its share of the text's n-grams times SCALE."""
    row, idx = raw_features(data, offsets)
    total = np.bincount(row, minlength=len(offsets) - 1)
    key, count = np.unique((row << FTRL.bits) + idx, return_counts=True)
    row, idx = key >> FTRL.bits, key & ((1 << FTRL.bits) - 1)
    return row, idx, count * SCALE / total[row]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_TRAIN) -> np.ndarray:
    return linear.fit(docs, labels, doc_id, text, label, features, FTRL, limit)


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2^bits + 1 numbers, whatever the input

    def margin(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = shared.value
        row, idx = raw_features(data, offsets)
        n = len(offsets) - 1
        return np.bincount(row, weights=w[idx], minlength=n) * SCALE / np.maximum(np.bincount(row, minlength=n), 1) + w[-1]

    return linear.apply(docs, doc_id, text, margin)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model fitted on the labels that aren't held out."""
    return linear.verdicts(score(docs, fit(docs, labels, doc_id, text, label), doc_id, text), threshold)
