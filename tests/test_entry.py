"""The registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def _same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(repr([_same(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert rows
        return
    expected = db.sql(catalogue.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(repr([_same(r[k]) for k in at]) for r in expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
