"""Every query that has SQL gives what the SQL gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from ledgerloom.plans import log_queries, table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = table_queries.ORACLE | log_queries.ORACLE


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if type(v).__name__ in ("date", "datetime", "Timestamp"):
        return str(pd.Timestamp(v))
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.item() if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(cell, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    got, want = __spark_entry__.queries()[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
