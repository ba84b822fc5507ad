"""A copy with an insertion, which has a copy of its own, still repeats the first document."""

import random

from taxolens.llm import op1_substring_dedup


def test_older_holder_behind_a_younger_one(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n))
    head, tail, inserted = prose(120), prose(120), prose(60)
    grown = f"{head} {inserted} {tail}"
    docs = spark.createDataFrame([(1, f"{head} {tail}"), (5, grown), (9, grown)], "doc_id bigint, text string")
    spans = op1_substring_dedup.repeats(docs).collect()
    repeated = lambda i, j: sum(s.stop - s.start for s in spans if s.doc_id == i and s.first_doc_id == j)
    assert repeated(5, 1) > 0.8 * len(head + tail) and repeated(5, 5) > 0.5 * len(inserted)
    assert sum(s.stop - s.start for s in spans if s.doc_id == 9 and s.first_doc_id < 9) == len(grown)
    left = {r.doc_id: r.text for r in op1_substring_dedup.without_repeats(docs).collect()}
    assert left[1] == f"{head} {tail}" and left[9] == ""
    assert inserted in left[5] and len(left[5]) < len(inserted) + 0.2 * len(head + tail)
