"""Runs a query and its DuckDB SQL over the same Parquet tables and compares their rows."""

import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return v


def table(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).itertuples(index=False, name=None))


def connect(data: str = DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def agree(spark, query, sql: str, data: str = DATA) -> None:
    got, want = query(spark, data).toPandas(), connect(data).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
