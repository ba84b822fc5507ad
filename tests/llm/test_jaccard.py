"""The pipeline's near-duplicate links against brute-force Jaccard similarity."""

import random

import pytest
from test_text_operators import plain_fingerprint

from taxolens.llm import jaccard


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_group(docs, radius):
    """The least id of each document's component, by all pairs."""
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets, prints = {i: plain_set(t) for i, t in docs}, {i: plain_fingerprint(t, 5) for i, t in docs}
    for i, _ in docs:
        for j, _ in docs:
            if i < j:
                both = len(sets[i] & sets[j])
                alike = 5 * both >= 4 * len(sets[i] | sets[j]) and both
                if alike or (prints[i] ^ prints[j]).bit_count() <= radius:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i, _ in docs}


def near_copies():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(2000)]
    stock = rng.choices(pool, k=40)
    docs = []
    for n in range(12):
        body = rng.choices(pool, k=rng.choice([7, 30, 60, 150, 400])) + (stock if n % 2 else [])
        docs.append(body)
        for _ in range(40 if n == 3 else 5):
            copy = list(body)
            for _ in range(rng.choice([1, 1, 2, 3, 6])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 2])] = rng.choices(pool, k=rng.choice([1, 2, 8]))
            docs.append(copy)
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, ""), (901, ""), (902, "  "), (903, "one two")]


@pytest.mark.parametrize("hot", [2, 1000])
def test_groups_against_all_pairs(spark, hot):
    docs = near_copies()
    got = {r.doc_id: r.component_id for r in jaccard.group(spark.createDataFrame(docs, "doc_id bigint, text string"), 5, 2, hot=hot).collect()}
    assert got == plain_group(docs, 2)


def test_shingles_that_few_texts_of_each_task_share(spark):
    """One line in three texts of each of 40 tasks: no task sees it often, but it must not make all of them pairs."""
    rng = random.Random(3)
    line = " ".join(f"l{i}" for i in range(12))
    rows = []
    for task in range(40):
        for i in range(6):
            body = [f"w{rng.randrange(10**6)}" for _ in range(40)]
            rows.append((task * 6 + i, " ".join(body[:20]) + " " + (line if i < 3 else "other") + " " + " ".join(body[20:])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(40, "doc_id")
    none = (jaccard.np.zeros(0, jaccard.np.uint64), jaccard.np.zeros(0, jaccard.np.int64))
    before = jaccard.prefixes(docs, 5, none)
    after, _ = jaccard._ordered(docs, 5, none, "text")
    pairs = lambda r: sum(n * (n - 1) // 2 for (n,) in r.groupBy("token").count().select("count").collect())
    assert pairs(before) > 5000 and pairs(after) <= len(rows)
    got = {r.doc_id: r.component_id for r in jaccard.group(docs, 5, 2).collect()}
    assert got == {i: i for i, _ in rows}


@pytest.mark.parametrize("large", [0, 3])
def test_any_order_gives_all_links(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard, "LARGE", large)
    docs = near_copies()
    got = {r.doc_id: r.component_id for r in jaccard.group(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 5, 2).collect()}
    assert got == plain_group(docs, 2)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "  ", "c"), (4, long, "d"), (5, long, "e"), (6, "one word", "f"), (6, "one word", "g"), (None, "one word", "h"), (7, "é", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    kept = jaccard.first_of_groups(docs, 5, 2)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0 for r in kept.collect())) == [0, 1, 4, 6, 7]
    assert jaccard.first_of_groups(docs.limit(0), 5, 2).count() == 0


def test_stage_drops_a_copy_with_a_changed_word(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(120)]
    other = [*words[:60], "changed", *words[61:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words))), (None, " ".join(words))], "doc_id bigint, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1, 3]


def test_a_large_group_of_near_copies_makes_no_square(spark, monkeypatch):
    """A text with one or two words changed, 300 times: most copies are similar to few others only, and yet pairs grow with texts."""
    rng = random.Random(9)
    body = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(f"x{i}n{at}" if at in changed else w for at, w in enumerate(body))) for i in range(300) for changed in [rng.sample(range(150), rng.choice([1, 2, 2, 2]))]]
    asked = []

    def counted(docs, pairs, *rest, real=jaccard.linked):
        asked.append(pairs.count())
        return real(docs, pairs, *rest)

    monkeypatch.setattr(jaccard, "linked", counted)
    got = {r.doc_id: r.component_id for r in jaccard.group(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), 5, 2).collect()}
    assert got == plain_group(docs, 2) and max(list(got.values()).count(i) for i in set(got.values())) > 250
    assert sum(asked) <= 5 * len(docs)
