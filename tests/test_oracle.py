"""Every reference-side query against its SQL, on whole tables."""

import os

import duckdb
import pandas as pd
import pytest

from vecforge.plans.oracle import oracle_sql
from vecforge.plans.queries import queries

SQL, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-6)
