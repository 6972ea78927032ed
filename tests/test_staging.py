"""Derived tables: one for each state of their source, none after the session."""

import os
import subprocess
import sys

import pytest

from monthmark.sources import staging

ENDING = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
from monthmark.sources.staging import stored
assert stored(spark.range(5), "five").count() == 5
import os
assert sum(len(f) for _, _, f in os.walk(sys.argv[1])) > 0
{}
"""


def test_rewritten_input_is_noticed(spark, tmp_path):
    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(f"{source}/t.parquet")

    def rows(folder=source):
        return staging.staged(spark, folder, "t", build).count()

    spark.range(3).write.parquet(f"{source}/t.parquet")
    assert (rows(), rows(), rows(source + "/"), len(built)) == (3, 3, 3, 1)
    spark.range(4).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert (rows(), rows(), len(built)) == (4, 4, 2)
    spark.range(2).write.mode("append").parquet(f"{source}/t.parquet")
    assert (rows(), len(built)) == (6, 3)
    spark.range(1).write.parquet(f"{source}/other.parquet")  # any table of the source counts
    assert (rows(), len(built)) == (6, 4)


@pytest.mark.parametrize("end", ["", "spark.stop()"])
def test_nothing_is_left_behind(tmp_path, end):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", ENDING.format(end), str(tmp_path)], cwd=root, timeout=120,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


def test_release(spark, tmp_path):
    before = dict(staging._STAGED), dict(staging._SCRATCH)
    staging._STAGED.clear()
    staging._SCRATCH.clear()
    try:
        spark.range(3).write.parquet(f"{tmp_path}/in/t.parquet")
        df = staging.staged(spark, f"{tmp_path}/in", "t", lambda: spark.range(3))
        [file, *_] = df.inputFiles()
        path = file.removeprefix("file:").replace("///", "/")
        assert df.count() == 3 and os.path.exists(path)
        staging.release(spark)
        assert not os.path.exists(path) and not staging._STAGED
        assert staging.staged(spark, f"{tmp_path}/in", "t", lambda: spark.range(3)).count() == 3
    finally:
        staging._STAGED.update(before[0])
        staging._SCRATCH.update(before[1])


def test_panel_is_dealt_once_and_narrow(spark, tmp_path):
    """First dates are joined to orders, and lines are shuffled for the panel once, before names are made."""
    from datetime import date

    from monthmark.plans.fixtures import Tables

    # Order 2 has no line of a known part and dates nobody, order 4 has no customer, order 3 comes twice.
    orders = [(1, 7, date(1998, 3, 5)), (2, 7, date(1997, 1, 1)), (3, 7, date(1998, 2, 1)), (3, 8, date(1998, 6, 1)),
              (4, None, date(1998, 1, 1)), (5, 9, None)]
    lines = [(o, p, 3, 1, 5.0, 10.0, "R") for o, p in ((1, 1), (1, 1), (2, 99), (3, 2), (4, 1), (5, 1))]
    given = {"orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date"),
             "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_returnflag string"),
             "part": ([(1, "SMALL", 3), (2, "LARGE", 4)], "p_partkey long, p_type string, p_size int"),
             "supplier": ([(3, "s")], "s_suppkey long, s_name string")}
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Tables(spark, str(tmp_path))
    got = sorted((r.policy, r.inforce_mm or 0, r.vehicle_no, str(r.policy_expiry_date)) for r in t.panel.collect())
    assert got == [("00000007", 2, "01", "1999-02-01"), ("00000007", 3, "02", "1999-02-01"),
                   ("00000007", 3, "02", "1999-02-01"), ("00000008", 6, "01", "1999-06-01"),
                   ("00000009", 0, "02", "None")]
    plan = t._panel()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "lpad" not in plan[plan.index("Exchange"):]
    # The tables made from lines are grouped and joined by numbers.
    for build in (t._policies, t._vehicles, t._drivers, t._assignments):
        plan = build()._jdf.queryExecution().executedPlan().toString()
        assert "lpad" not in plan[plan.index("Exchange"):]
    assert [r.family_id for r in t.assignments.orderBy("family_id").collect()] == ["FAM000007"] * 2 + ["FAM000008"]
    assert {r.family_id for r in t.policies.collect()} == {"FAM000007", "FAM000008", "FAM000009", None}


def test_derived_tables_take_little_space(spark, tmp_path):
    """A policy's rows lie side by side in a month of the panel; derived tables are compressed with Zstandard."""
    from datetime import date

    from monthmark.plans.fixtures import Tables

    orders = [(o, o * 7919 % 50, date(1998, 1 + o % 2, 1 + o % 28)) for o in range(400)]
    lines = [(o * 13 % 400, 1, 3, 1, 5.0, 10.0, "R") for o in range(1600)]
    given = {"orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date"),
             "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_returnflag string"),
             "part": ([(1, "SMALL", 3)], "p_partkey long, p_type string, p_size int"),
             "supplier": ([(3, "s")], "s_suppkey long, s_name string")}
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    panel = Tables(spark, str(tmp_path)).panel
    files = panel.inputFiles()
    assert len(files) == 2 and all(f.endswith(".zstd.parquet") for f in files) and panel.count() == 1600
    for f in files:
        policies = [r.policy for r in spark.read.parquet(f).collect()]
        assert policies == sorted(policies)
