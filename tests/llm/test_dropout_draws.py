"""Merge-dropout: draws of each occurrence against a plain, one-by-one agenda."""

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import SAMPLES, words

from taxolens.llm import op7_sentencepiece, textkit
from taxolens.llm.queries import MODEL_FILE


@pytest.fixture(scope="module")
def vocabulary():
    return op7_sentencepiece.Vocabulary.load(MODEL_FILE)


def plain_unit(v, pairs, text, skip):
    """The pieces of one unit: scan all neighbours for the best candidate, merge, number what comes up, again and again."""
    ids, number = [int(v.char_id[ord(c)]) for c in text], 0
    size = [1] * len(ids)
    live = {}

    def came_up(i):
        nonlocal number
        if 0 <= i < len(ids) - 1 and (made := pairs.get((ids[i], ids[i + 1]))) is not None:
            live[i] = None if skip(number) else made
            number += 1
        elif 0 <= i:
            live.pop(i, None)

    for i in range(len(ids)):
        came_up(i)
    while any(m is not None for m in live.values()):
        at = min((i for i, m in live.items() if m is not None), key=lambda i: (v.rank[live[i]], i))
        ids[at : at + 2], size[at : at + 2] = [live[at]], [size[at] + size[at + 1]]
        live = {(i if i < at else i - 1): m for i, m in live.items() if i not in (at - 1, at, at + 1)}
        came_up(at - 1)
        came_up(at)
    out, place = [], 0
    for i, n in zip(ids, size):
        out += [i] if i >= 0 else v.byte_id[list(text[place].encode())].tolist()
        place += n
    return out


def encoded(v, texts, documents, dropout=0.3, seed=5):
    e, out = op7_sentencepiece.Encoder(v, dropout, seed), []
    for lo, hi, data, offsets in textkit.text_chunks(pa.array(texts, pa.string())):
        ids, ptr, _, _ = e.chunk(data, offsets, np.array(documents[lo:hi], np.int64))
        out += [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])]
    return out


def test_every_occurrence_has_its_own_draws(vocabulary):
    import re

    v, seed, dropout = vocabulary, 5, 0.3
    pairs = {(int(k) >> 20, int(k) & 0xFFFFF): int(i) for k, i in zip(v.pair_key, v.pair_id)}
    texts = [*SAMPLES, "token " * 40, words(60, 9), words(60, 9)]
    got = encoded(v, texts, range(len(texts)))
    u, m = np.uint64, textkit.mix
    for d, (text, ids) in enumerate(zip(texts, got)):
        want = []
        body = " " + text if text else ""
        for n, unit in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", body)):
            with np.errstate(over="ignore"):
                salt = u((seed * 0x2545F4914F6CDD1D + 1) % (1 << 64))
                key = m(m(np.array([d], u) + salt) + np.array([n], u) * u(0xC2B2AE3D27D4EB4F))
            want += plain_unit(v, pairs, unit, lambda t, key=key: bool(op7_sentencepiece.drawn(key, np.array([t]), dropout)[0]))
        assert ids == want
    assert got[-1] != got[-2]
    runs = {tuple(x) for x in np.array_split(got[len(SAMPLES)], 40) if len(x)}
    assert len(runs) > 3


def test_segmentations_grow_with_occurrences(spark):
    """One word in many documents: far more than a few segmentations, and each decodes to the same text."""
    docs = spark.createDataFrame([(i, " internationalisation") for i in range(400)], "doc_id bigint, text string")
    got = op7_sentencepiece.encode(docs, MODEL_FILE, dropout=0.3).collect()
    assert len({tuple(r.ids) for r in got}) > 20 and all(r.lossless for r in got)
    again = {r.doc_id: r.ids for r in op7_sentencepiece.encode(docs.repartition(7), MODEL_FILE, dropout=0.3).collect()}
    assert all(again[r.doc_id] == r.ids for r in got)


def test_share_of_skipped_candidates(vocabulary):
    keys = textkit.mix(np.arange(2000, dtype=np.uint64))
    _, t, skipped = op7_sentencepiece.each_draw(keys, np.full(2000, 30), 0.1)
    assert abs(skipped.mean() - 0.1) < 0.005 and np.abs(np.bincount(t[skipped]) / 2000 - 0.1).max() < 0.04
