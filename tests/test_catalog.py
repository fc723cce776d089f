"""Every core query runs on the smallest tables and equals its SQL twin."""

import os

import duckdb
import pandas as pd
import pytest

from lavra.plans.catalog import ORACLE, QUERIES

FOLDER = os.environ.get("LAVRA_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def cell(v):
    if v is None or (not isinstance(v, list) and pd.isna(v)):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    if name not in ORACLE:
        assert got.count() > 0 and len(set(got.columns)) == len(got.columns)  # rows: tests/test_expected_rows.py
        return
    kinds = {r[0]: r[1] for r in sql.execute(f"describe {ORACLE[name]}").fetchall()}
    assert {c: KINDS[t] for c, t in got.dtypes} == kinds
    assert rows(got.toPandas()) == rows(sql.execute(ORACLE[name]).df())
