import decimal

import duckdb
import pandas as pd
import pytest

from keyloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (int, float, bool, decimal.Decimal)):
        return float(v)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = duck.execute(registry.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(str([plain(v) for v in row]) for row in got.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
