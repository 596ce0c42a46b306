"""Every registered query against its SQL on the smallest data set."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from leadloom.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
BUILDS, SQLS = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data), sorted(names)


@pytest.mark.parametrize("name", list(BUILDS))
def test_query(spark, duck, name):
    df = BUILDS[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name not in SQLS:
        assert df.columns
        return
    cur = duck.execute(SQLS[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert _rows(df.columns, got) == want


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(BUILDS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
