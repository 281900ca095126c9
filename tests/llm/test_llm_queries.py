"""The problems' queries run and, where there is SQL, give its rows."""

import glob
import os

import duckdb
import pytest

from lakefold.llm import queries as llm

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, ROOT)
    rows = df.collect()
    if name in llm.oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{ROOT}/*.parquet"):
            con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        result = con.sql(llm.oracle_sql()[name])
        assert sorted(tuple(r[c] for c in result.columns) for r in rows) == sorted(result.fetchall())
