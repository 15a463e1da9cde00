"""Every core query with SQL against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from ringside import queries


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    one = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, small, duck, name):
    ours = queries.queries()[name](spark, small).toPandas()
    theirs = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
