"""Every query with SQL against DuckDB, on the smallest tables; every other one runs and has a stable schema."""

import math
import os

import duckdb
import pytest

from tidalframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def norm(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.5f}".replace("-0.00000", "0.00000") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    cols = sorted(got.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    a, b = norm(map(tuple, got.select([f"`{c}`" for c in cols]).collect())), norm([tuple(r[i] for i in order) for r in want.fetchall()])
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or abs(float(p) - float(q)) < 2e-5 for p, q in zip(x, y)), name


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert {"series_id", "ts", "value", "z_score"} == set(e.entry(spark).columns)
    assert set(e.oracle_sql()) <= set(e.queries())
