"""Every registered query against its DuckDB text, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import duck, rows_of
from monthmark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_an_oracle_or_is_streaming():
    without = set(QUERIES) - set(ORACLES)
    assert all(name.startswith("stream_") for name in without), without


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct",
                   "BroadcastNestedLoopJoin"):
        assert banned not in plan, f"{name} plans a {banned}"
    cur = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0
