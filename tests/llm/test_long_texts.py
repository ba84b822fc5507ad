"""Texts of more than 100,000 words are judged by their ratios, not by their length."""

from taxolens.llm import op8_quality_rules


def test_long_clean_text_is_kept(spark):
    words = ["the" if i % 10 == 0 else f"word{i}" for i in range(100_050)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:60])), (3, "# " * 100_050)], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in op8_quality_rules.judge(docs).collect()} == {1: True, 2: True, 3: False}
    assert {r.doc_id for r in op8_quality_rules.kept_rows(docs).collect()} == {1, 2}
