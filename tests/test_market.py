"""Every registered query of the library itself against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarrylane.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(repr([r[c] for c in order]) for r in rows)
    theirs = sorted(repr([r[names.index(c)] for c in order]) for r in found.fetchall())
    assert ours == theirs


def test_dimension_joins_need_no_python(spark):
    plan = registry.QUERIES["area_growth"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
