"""Every registered query with SQL equals that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from colloquy.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def _rows(rows):
    clean = lambda v: (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = Q.queries()[name](spark, DATA)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert _rows(tuple(r) for r in got.collect()) == _rows(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, DATA).count() > 0
