"""Every query that has SQL against DuckDB, and the contract of the entry."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__
from loomtext.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    q = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in q.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in r]) for r in q.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["G11_length_histogram", "H2_quota_sample"])
def test_words_are_counted_once(spark, sf, name):
    """Not once for each branch of the markers; a filter may need them once more."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_extract_all") <= 3
