"""Every registered query with SQL gives the rows its SQL gives, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from lakefold.plans import registry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:-9] if s.endswith("T00:00:00") else s
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, ROOT)
    names = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=_key)
    result = duck.sql(registry.oracle_sql()[name])
    assert names == sorted(result.columns)
    at = [result.columns.index(c) for c in names]
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in result.fetchall()), key=_key)


def test_rows_only_queries_run(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, ROOT).columns


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_readers_run_over_all_values(spark, duck):
    everything = duck.sql("select count(*), count(*) filter (regexp_matches(val, '^₹ [0-9.]+$')) from tijori").fetchall()[0]
    for name in ("numeric_parse", "date_parse"):
        assert registry.queries()[name](spark, ROOT).count() == everything[0]
    decorated = spark.read.parquet(f"{ROOT}/tijori.parquet").filter("val rlike '^₹ [0-9.]+$'").select("rec_id")
    assert registry.queries()["numeric_parse"](spark, ROOT).filter("number is not null").join(decorated, "rec_id").count() == everything[1] > 0
