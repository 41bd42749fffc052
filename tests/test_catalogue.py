"""Every query against its SQL at the smallest size."""

import math

import duckdb
import pandas as pd
import pytest

from quarrylens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    df = df.reindex(sorted(df.columns), axis=1)
    plain = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else round(x, 6) + 0.0 if isinstance(x, float) else str(x)
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    assert got == rows(con.sql(catalogue.ORACLE_SQL[name]).df())
    assert got[1]
