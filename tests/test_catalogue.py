"""Queries against DuckDB on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from slotweave.plans import catalogue

DATA = "/root/testdata/sf0.001"


pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def canon(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    show = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)
