"""The near-duplicate stage with rows that share an id."""

from test_text_operators import words


def test_rows_that_share_an_id_are_judged_by_text(spark):
    import corpus_pipeline

    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, c, "p"), (7, c, "q"), (None, a, "n"), (None, a, "n")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, node string"), "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(3, a), (5, b), (7, c), (-1, a), (-1, a)])
