"""Every query of the catalog beside its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(SF)):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return "none"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())
