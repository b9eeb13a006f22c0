"""Each registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def comparable(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "~"
        return f"{float(x):.9g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name in registry.ORACLE:
        want = tables.sql(registry.ORACLE[name])
        assert sorted(want.columns) == columns
        assert comparable(rows) == comparable(tables.sql(f"select {', '.join(columns)} from want").fetchall())
    assert rows or name == "w14_rate_limit"
