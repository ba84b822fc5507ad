"""Substring dedup against a plain walk over chunks, by length of words, with clashing names, and its join on frequent keys."""

from pyspark.sql import functions as F
from test_text_operators import words

from taxolens.llm import op1_substring_dedup


def test_passages_of_short_and_long_words(spark):
    """Of passages of 51 words in two documents, 0.99 or more are caught, whatever the length of the words."""
    import random

    rng = random.Random(7)
    docs, n = [], 120
    for size in range(1, 7):
        pool = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=max(1, size + (rng.randint(-1, 1) if size > 1 else 0)))) for _ in range(3000)]
        some = lambda k: " ".join(rng.choices(pool, k=k))  # noqa: B023, E731
        for i in range(n):
            passage = some(51)
            docs += [(size * 1000 + 2 * i, f"{some(70)} {passage} {some(40)}"), (size * 1000 + 2 * i + 1, f"{some(30)} {passage} {some(70)}")]
    got = {r.doc_id for r in op1_substring_dedup.repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).select("doc_id").distinct().collect()}
    for size in range(1, 7):
        assert sum(size * 1000 + 2 * i in got and size * 1000 + 2 * i + 1 in got for i in range(n)) >= 0.99 * n


def plain_ends(data):
    """Chunk ends of one text, byte by byte: words, the gear hash at their beginnings, local minima, 256 bytes at most."""
    import numpy as np

    op, space = op1_substring_dedup, b" \t\n\v\f\r"
    begins, since = [], 0
    for i, c in enumerate(data):
        if c in space:
            continue
        if i == 0 or data[i - 1] in space:
            begins.append(i)
            since = i
        elif i - since > op.LONG_RUN and c & 0xC0 != 0x80:
            begins.append(i)
    begins = [p for p in begins if p > 0]

    def hashed(p):
        low = sum(int(op.GEAR[data[p - 1 - j]]) << j for j in range(min(32, p))) & 0xFFFF
        return int(op.mix(np.array([low], np.uint64))[0]) >> 1

    v, ends, last = [hashed(p) for p in begins], [], 0
    for i, p in enumerate(begins):
        if all(v[i] < x for x in v[max(i - op.REACH, 0) : i]) and all(v[i] <= x for x in v[i + 1 : i + 1 + op.REACH]):
            ends.append(p)
    out = []
    for end in [*ends, len(data)] if data else []:
        while end - last > op.MAX_CHUNK:
            last += op.MAX_CHUNK
            out.append(last)
        out.append(end)
        last = end
    return out


def plain_chunk_repeats(docs):
    """Spans by a plain walk over each text's chunks: dictionaries in place of joins and windows."""
    op = op1_substring_dedup
    places, own = {}, {}
    for i, text in docs:
        data = (text or "").encode()
        ends = plain_ends(data)
        own[i, text] = [(a, b, data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        for a, _, body in own[i, text]:
            places.setdefault(body, set()).add((i, text, a))
    out = set()
    for (i, text), parts in own.items():
        run = []
        for a, b, body in [*parts, (0, 0, None)]:
            if body is not None and len(places[body]) > 1:
                least = min(p[0] for p in places[body])
                run.append((a, b, least, least == i and a == min(p[2] for p in places[body] if p[:2] == (i, text)), body))
                continue
            if run and len(text.encode()[run[0][0] : run[-1][1]].split()) >= op.MIN_SPAN_WORDS:
                first = None
                for x, y, least, here, _ in run:
                    if first is not None and here == first[3]:
                        first = (first[0], y, max(first[2], least), here)
                    else:
                        out |= {(i, *first)} if first else set()
                        first = (x, y, least, here)
                out.add((i, *first))
            run = []
    return out


def test_boundaries_against_a_plain_walk():
    import numpy as np

    op = op1_substring_dedup
    texts = [words(400, 5), "", " ", "a", "x" * 900, "é" * 300 + " end", " \n lead " + words(40, 6), "ab " * 300, words(30, 7) + " " + "y" * 700 + " " + words(30, 8)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ends, ptr = op.cuts(data, offsets)
    assert [(ends[ptr[i] : ptr[i + 1]] - offsets[i]).tolist() for i in range(len(raw))] == [plain_ends(r) for r in raw]


def test_a_passage_twice_in_one_text_and_in_two_texts_of_one_id(spark):
    passage = words(80, 31, 3000)
    inside = f"{words(30, 32, 3000)} {passage} {words(40, 33, 3000)} {passage} {words(20, 34, 3000)}"
    one, two = f"{words(30, 35, 3000)} {words(80, 36, 3000)}", f"{words(25, 37, 3000)} {words(80, 36, 3000)} {words(9, 38, 3000)}"
    df = spark.createDataFrame([(1, inside), (1, inside), (2, one), (2, two), (3, words(200, 39, 3000))], "doc_id bigint, text string")
    got = op1_substring_dedup.repeats(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.first_doc_id == r.doc_id for r in got)
    spans = sorted((r.start, r.first_here, r.n_words) for r in got if r.doc_id == 1)
    assert [here for _, here, _ in spans] == [True, False] and min(n for *_, n in spans) > 60
    assert sorted(r.first_here for r in got if r.doc_id == 2) == [False, True] and len({r.text_key for r in got if r.doc_id == 2}) == 2
    left = [(r.doc_id, len(r.text.split())) for r in op1_substring_dedup.without_repeats(df).collect()]
    assert [n < len(inside.split()) - 60 for i, n in left if i == 1] == [True, True]
    assert sum(n for i, n in left if i == 2) < len(one.split()) + len(two.split()) - 60


def test_spans_against_a_plain_walk(spark):
    x, y = words(70, 11, 3000), words(70, 12, 3000)
    docs = [(1, x), (2, f"{x} {y}"), (3, f"{x} {y}"), (4, words(50, 13, 3000)), (5, f"{words(30, 14, 3000)} {y}"), (5, f"{words(30, 15, 3000)} {x}"), (6, None), (7, "")]
    docs += [(8, f"{words(20, 16, 3000)} {y} {words(20, 17, 3000)} {y}"), (9, f"{words(60, 18, 3000)} {words(60, 18, 3000)}")]
    docs += [(20 + i, f"{words(25, 100 + i, 3000)} {x[: 40 * i]} {words(25, 200 + i, 3000)}") for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.start, r.stop, r.first_doc_id, r.first_here) for r in op1_substring_dedup.repeats(df).collect()}
    assert got == plain_chunk_repeats([d for d in docs if d[1] is not None])
    left = {(r.doc_id, r.text) for r in op1_substring_dedup.without_repeats(df).collect() if r.doc_id in (1, 2, 3)}
    kept = {i: t for i, t in left}
    assert kept[1] == x and kept[3] == "" and len(kept[2]) < len(y) + 60 and kept[2].endswith(y[60:])


def test_columns_of_any_name_are_kept(spark):
    names = ["_cut", "_text_key", "cut", "row", "body", "key", "id", "_hot", "_k", "least", "place"]
    shared = words(90, 21)
    rows = [(i, f"{words(30, 30 + i)} {shared}", *[f"{c}{i}" for c in names]) for i in range(3)] + [(None, shared, *names)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names))
    got = op1_substring_dedup.without_repeats(df)
    assert got.columns == df.columns and sorted(tuple(r)[2:] for r in got.collect()) == sorted(tuple(r)[2:] for r in rows)
    assert op1_substring_dedup.without_repeats(df.withColumn("text", F.lit(None).cast("string"))).where("text IS NOT NULL").count() == 0


def test_frequent_keys_join_whole(spark, monkeypatch):
    from taxolens.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 5), (3, 4), (4, 1), (5, 7)) for i in range(n)] + [(None, 0)], "k bigint, i int")
    facts = rows.where("k < 5").groupBy("k").agg(F.max("i").alias("top"), F.count("*").alias("n"))
    got = sorted(map(tuple, common.spread_join(rows, facts, ["k"]).collect()))
    assert got == sorted((k, i, n - 1) for k, n in ((1, 9), (2, 5), (3, 4), (4, 1)) for i in range(n))
