"""Every query beside its SQL twin, on the smallest test data, as the driver compares them."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rounded(x):
    return float(f"{x:.9g}") if isinstance(x, float) else tuple(map(rounded, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(rounded(x[c]) for c in columns) for x in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        result = duck.sql(sql)
        assert sorted(result.columns) == columns
        places = [result.columns.index(c) for c in columns]
        assert got == Counter(tuple(rounded(x[i]) for i in places) for x in result.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {f"p{n}_found" for n in range(1, 6)} <= set(entry.queries())
