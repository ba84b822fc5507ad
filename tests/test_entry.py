"""The driver contract: names, and each query of the engine against its SQL on the smallest tables."""

import importlib.util
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_follows_the_text_operators():
    import __spark_entry__ as e

    there = importlib.util.find_spec("taxolens.llm") is not None and importlib.util.find_spec("taxolens.llm.queries") is not None
    assert any(k.startswith("op") and k[2].isdigit() for k in e.queries()) == there


def plain(v):
    return None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v


def same(spark, duck, key):
    from taxolens.plans import catalogue

    want = duck.sql(catalogue.ORACLES[key]).df()
    got = catalogue.QUERIES[key](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda f: sorted((tuple(plain(v) for v in r) for r in f[columns].astype(object).values.tolist()), key=str)
    a, b = rows(want), rows(got)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and v == pytest.approx(u, abs=2e-5), (key, x, y)


def keys():
    from taxolens.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.mark.parametrize("key", keys())
def test_query_against_sql(spark, duck, key):
    same(spark, duck, key)
