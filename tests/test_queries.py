"""Every registered query runs on the smallest tables, and equals its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from loomspark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].round(6).map(lambda v: "null" if pd.isna(v) else f"{v:.6f}") if df[c].dtype.kind == "f" else df[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        pd.testing.assert_frame_equal(canonical(got), canonical(con.sql(ORACLES[name]).df()), check_dtype=False)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
