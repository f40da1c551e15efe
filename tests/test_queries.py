"""Every registered query against its SQL on the smallest scale."""

import math
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(df):
    def text(v):
        if pd.isna(v):
            return ""
        return repr(round(float(v), 5)) if isinstance(v, float) and math.isfinite(v) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(text(v) for v in row) for row in df.values.tolist())


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    whole = {c for c in want.columns if "int" in str(want[c].dtype).lower()}
    for c in whole:
        got[c], want[c] = got[c].astype("Int64").astype(object), want[c].astype("Int64").astype(object)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert registry.entry(spark).count() == 8
