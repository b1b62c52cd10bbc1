"""Every registered query beside its SQL in DuckDB, at the smallest scale."""

import glob
import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from castlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return json.dumps([str(y) for y in x])
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if x == int(x) else repr(round(float(x), 6))
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(tuple, df.map(plain).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
