"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_have_a_test_of_their_own():
    from pathlib import Path

    tests = Path(__file__).with_name("test_brute.py").read_text()
    assert not [n for n in set(registry.QUERIES) - set(registry.ORACLE) if f'"{n}"' not in tests]
