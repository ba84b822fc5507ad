"""The corpus pipeline and the text queries' SQL, on the smallest tables, against plain versions."""

import os
import re
import sys

import pytest
from test_jaccard import plain_group
from test_text_operators import plain_base, plain_hits, plain_measures

from taxolens.llm import op8_quality_rules, op10_secret_scan
from taxolens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_against_sql(spark, duck, key):
    want = duck.sql(ORACLES[key]()).df()
    got = QUERIES[key](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda f: sorted((tuple(None if v is None or v != v else v for v in r) for r in f[sorted(want.columns)].astype(object).values.tolist()), key=str)
    assert rows(want) == rows(got)


def test_pipeline_against_plain_stages(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as c

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    kept = {r.doc_id for r in op8_quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert not any(plain_measures(t)[5] for i, t in docs if i in kept)
    docs = [d for d in docs if d[0] in kept]
    group = plain_group(docs, c.RADIUS)
    docs = [d for d in docs if group[d[0]] == d[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if not plain_hits(d[1], items)[4]]
    got = c.run(spark, SF)
    out = {r.doc_id: r for r in got.collect()}
    assert set(out) == {i for i, _ in docs} and all(r.lossless for r in out.values())
    from taxolens.llm.op7_sentencepiece import decode

    clean = {r.doc_id: r.text for r in decode(got, c.MODEL_FILE).collect()}
    mark = re.escape("[SECRET]")
    empty = plain_base("")
    for i, text in docs:
        if plain_base(text) == empty and clean[i] != text:
            assert any(re.search(r.pattern, text) for r in op10_secret_scan.MORE_RULES)
        assert clean[i] == text or re.search(mark, clean[i])


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(c.STAGES) <= 5
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
