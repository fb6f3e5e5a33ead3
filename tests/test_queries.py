"""Every catalog query against its SQL oracle on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from bindery.oracles import ORACLE_SQL
from bindery.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
