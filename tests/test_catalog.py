"""Every query of the catalog against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pagemill.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return ""
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53:
        v = float(v)  # a column of whole numbers with nulls may come as either
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    got = all_queries()[name](spark, DATA).toPandas()
    assert len(got)
    if name in all_sql():
        assert table(got) == table(duck.execute(all_sql()[name]).fetchdf())
