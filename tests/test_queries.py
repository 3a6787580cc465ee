"""Every registered query runs and agrees with its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

SF = "/root/testdata/sf0.001"
# Queries of the subpackage ``llm`` have their own tests.
QUERIES = {k: q for k, q in entry.queries().items() if ".llm" not in q.__module__ and k != "pipeline"}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want
