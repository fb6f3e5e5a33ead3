"""The corpus queries against their SQL oracles on the smallest tables."""

import glob
import os

import pytest

from bindery.llm.oracles import ORACLE_SQL
from bindery.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(expected, key=str)


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys() and ORACLE_SQL.keys() <= entry.oracle_sql().keys() and "pipeline" in entry.queries()
