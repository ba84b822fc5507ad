"""Ranked search against scores worked out term by term for every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import ODD, frame, words

from taxolens.llm import op12_ranked_search as o

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, top):
    """Rows of each item's best documents."""
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total
            found = [t for t in set(TERM.findall((text or "").translate(LOWER))) if t in c]
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in found)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    common = [words(60, i, 40) for i in range(120)]
    copies = [words(30, 900, 40)] * 70
    return [*enumerate([*ODD, *common, *copies, words(3, 5), "Zebra zebra ZEBRA 😀 42", "É é"]), (None, common[3]), (7, common[3]), (7, common[3])]


ITEMS = [("a", words(20, 3, 40)), ("b", words(30, 900, 40)), ("c", "zebra, 42"), ("d", None), ("e", ""), ("f", "not in any text, at all: qqqq"), (None, "a b word é"), ("a", words(20, 3, 40)), ("g", words(400, 8, 40))]


def tables(spark, docs):
    rows = [(i, t, 0.5, "x", 3) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double, rank string, item_id int"), spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id string, text string, doc_id int")


@pytest.mark.parametrize(("first", "many"), [(1, 100), (2048, 100), (64, 2)])
def test_search_against_every_document(spark, docs, monkeypatch, first, many):
    monkeypatch.setattr(o, "ITEMS", many)
    monkeypatch.setattr(o, "FIRST_STEP", first)
    table, items = tables(spark, docs)
    for top, parts in ((5, 1), (50, 7)):
        got = o.search(table.repartition(parts), items, top=top)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, ITEMS, top)


def test_nothing_to_search_or_to_ask(spark, docs):
    table, items = tables(spark, docs)
    assert o.search(table.limit(0), items).collect() == o.search(table, items.limit(0)).collect() == []
    assert o.search(frame(spark, [None, "", " .,"]), items).collect() == []


def block(texts, words_):
    number = {w: i for i, w in enumerate(words_)}
    counts = [Counter(t.split()) for t in texts]
    n = np.array([sum(c.values()) for c in counts], np.int64)
    terms = [sorted(number[w] for w in c if w in number) for c in counts]
    at = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    flat = np.array([x for t in terms for x in t], np.int64)
    tfs = np.array([c[words_[x]] for c, t in zip(counts, terms) for x in t], np.int64)
    return o.Block(n, at, flat, tfs, pa.array(range(len(texts))), len(words_), len(texts), int(n.sum()))


def test_walk_stops_when_the_rest_cannot_matter(monkeypatch):
    """Rare terms settle the best documents; the common term's postings stay untouched, and scores are whole all the same."""
    monkeypatch.setattr(o, "FIRST_STEP", 4)
    texts = ["common " * (1 + i % 3) + ("rare odd" if i in (5, 17, 90) else "other") for i in range(400)]
    own = block(texts, ["common", "rare", "odd"])
    tested = []
    monkeypatch.setattr(o.Block, "_least", staticmethod(lambda score, sure, top, f=o.Block._least: tested.append(int((score > 0).sum())) or f(score, sure, top)))
    weights = np.array([10, 9000, 8000])
    best, score = own.search(np.arange(3), weights, np.zeros(0, np.int64), 3)
    every = np.zeros(400, np.int64)
    np.add.at(every, np.repeat(np.arange(400), np.diff(own.at)), weights[own.terms] * own.impacts)
    order = np.lexsort((np.arange(400), -every))[:3]
    assert best.tolist() == order.tolist() and score.tolist() == every[order].tolist()
    assert max(tested) < 100


def test_earlier_blocks_leave_nothing_to_find():
    own = block(["a b", "a", "b b"], ["a", "b"])
    best, _ = own.search(np.arange(2), np.array([5, 7]), np.full(2, 10**15), 2)
    assert not len(best)


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(o, "span_hashes", lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    known = o.Vocabulary.of({b"ab", b"cd", b"xyz"})
    data = np.frombuffer(b"cdabxyzefyyy", np.uint8)
    starts, ends = np.array([0, 2, 4, 7, 9]), np.array([2, 4, 7, 9, 12])
    names = [known.data[a:b].tobytes() for a, b in zip(known.at, known.at[1:])]
    assert [names[i] if i >= 0 else None for i in known.find(data, starts, ends)] == [b"cd", b"ab", b"xyz", None, None]


def test_lengths_do_not_overflow():
    assert o.lengths(np.array([10**9, 3]), 10**12, 10**14).tolist() == [50 + 50 * 10**9 * 10**12 // 10**14, 50 + 50 * 3 * 10**12 // 10**14]


def test_random_blocks_against_plain_scores(monkeypatch):
    monkeypatch.setattr(o, "FIRST_STEP", 3)
    r = random.Random(2)
    names = [f"w{i}" for i in range(12)]
    for _ in range(60):
        texts = [" ".join(r.choices(names, k=1 + r.randrange(9))) for _ in range(40)]
        own = block(texts, names)
        terms = np.array(sorted(r.sample(range(12), 5)))
        weights = np.zeros(12, np.int64)
        weights[terms] = [r.choice([1, 50, 3000]) for _ in terms]
        every = np.zeros(40, np.int64)
        np.add.at(every, np.repeat(np.arange(40), np.diff(own.at)), weights[own.terms] * own.impacts)
        order = [i for i in np.lexsort((np.arange(40), -every)) if every[i] > 0][:6]
        best, score = own.search(terms, weights, np.zeros(0, np.int64), 6)
        assert best.tolist() == order and score.tolist() == every[order].tolist()
