"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    return None if pd.isna(v) else round(v, 9) if isinstance(v, float) else v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    mine, theirs = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    assert rows(mine, columns) == rows(theirs, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
