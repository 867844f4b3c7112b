"""Every registered query against its SQL twin on the smallest data, or at least that it runs."""

import duckdb
import pandas as pd
import pytest

from recollex import catalog
from recollex.session import TABLES

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.9g}" if hasattr(v, "__float__") else str(v)


def cells(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(found.columns) and len(set(found.columns)) == len(found.columns)
        return
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(want.columns)
    assert cells(found) == cells(want)
