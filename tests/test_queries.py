"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def tidy(df, cols):
    def text(v):
        return str(round(v, 4)).removesuffix(".0") if isinstance(v, float) else str(v)

    return sorted(tuple("None" if pd.isna(v) else text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert tidy(got, cols) == tidy(want, cols)


def test_entry(spark):
    assert entry.entry(spark).count() == 40
