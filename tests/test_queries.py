"""Every grid query against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cellbeam.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype == object and df[k].map(lambda v: v is None or isinstance(v, (bool, np.bool_))).all():
            df[k] = df[k].map(lambda v: np.nan if v is None else float(v))
        elif pd.api.types.is_bool_dtype(df[k]) or pd.api.types.is_numeric_dtype(df[k]):
            df[k] = df[k].astype(float)
        else:
            df[k] = df[k].astype(object)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    a, b = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
