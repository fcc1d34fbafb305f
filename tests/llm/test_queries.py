import os

import duckdb
import pytest

from plumbline.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    got = sorted(tuple(x[c] for c in sorted(df.columns)) for x in df.collect()) if name != "p10_masked" else df.collect()
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        r = c.sql(queries.oracle_sql()[name])
        places = [r.columns.index(x) for x in sorted(df.columns)]
        assert got == sorted(tuple(x[i] for i in places) for x in r.fetchall())
    else:
        assert got
