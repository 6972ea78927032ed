"""A policy and a family with most of the rows, without any broadcast to hide behind."""

import pytest

from monthmark.functions.skew import MOST_HOT
from monthmark.operators import changes as ch
from monthmark.operators import lifecycle, lookups
from monthmark.operators import reconcile as rec
from tests.test_changes import month


@pytest.fixture
def sort_merge(spark):
    """Small thresholds make the skew handling work on test data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def hot_rows():
    """Policy 'hot': 3,000 assignments a month, of which one is exchanged in month 3."""
    rows = []
    for m in (1, 2, 3):
        rows += month(2018, m, *[(f"{v:05d}", "01") for v in range(3000)], policy="hot")
        for p in range(300):
            rows += month(2018, m, ("01", "01"), policy=f"p{p:03d}")
    rows[-301]["vehicle_no"] = "99999"
    return rows


def test_hot_policy(sort_merge, panel_of):
    panel = panel_of(hot_rows()).repartition(8).cache()
    changes = ch.policy_month_changes(panel)
    hit = changes.where("major_change").collect()
    assert [(r.policy, r.inforce_mm, r.added, r.removed) for r in hit] == [("hot", 3, 1, 1)]
    flagged = ch.flag_panel(panel)
    assert flagged.where("major_change").count() == 3000
    assert flagged.count() == panel.count()
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    # Nothing is broadcast but the hot keys, whose number is limited.
    lines = plan.splitlines()
    sent = [lines[i + 1] for i, x in enumerate(lines) if "BroadcastExchange" in x and "ReusedExchange" not in x]
    assert all(f"TakeOrderedAndProject(limit={MOST_HOT}" in x for x in sent), sent
    assert lookups.exposure_anomalies(panel).count() == 0
    assert rec.latest_month(panel).count() == 3300
    monthly = {r.month: (r.inforce_count, r.major_change_rows, r.major_change_policies)
               for r in lifecycle.monthly_distribution(panel, ch.changed_months(panel)).collect()}
    assert monthly == {1: (301, 0, 0), 2: (301, 0, 0), 3: (301, 3000, 1)}
    panel.unpersist()


def test_timeline_of_a_hot_month_is_spread(sort_merge, panel_of):
    """Most rows are one policy-month; no window holds them, and each has its place."""
    out = lookups.policy_timeline(panel_of(hot_rows()).where("inforce_mm = 1").repartition(8))
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x]
    assert windows and all("_n" in x and "vehicle_no" not in x for x in windows)
    rows = out.where("policy = 'hot'").orderBy("position").collect()
    assert [(r.position, r.vehicle_no) for r in rows] == [(v, f"{v:05d}") for v in range(3000)]
    files = [f for f in out.inputFiles() if "/ranges-" in f]
    assert sum(out.sparkSession.read.parquet(f).where("policy = 'hot'").count() > 0 for f in files) > 1


def test_monthly_report_reads_the_panel_once(spark, panel_of, tmp_path):
    """First months, sizes and sums come from one pass; only the flags add others."""
    panel_of(hot_rows()).write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    report = lifecycle.monthly_distribution(panel)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
    flags = ch.changed_months(panel)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    assert scans(lifecycle.monthly_distribution(panel, flags)) == 1 + scans(flags)


def test_wide_aggregates_get_as_many_tasks_as_rows_ask_for(spark, panel_of):
    """Not the session's shuffle partitions, which stay the same as tables grow."""
    from pyspark.sql import functions as F

    from monthmark.functions.skew import in_tasks
    from monthmark.operators import lifecycle, lookups, quality

    rows = spark.range(1000).select((F.col("id") % 300).alias("k"))
    dealt = in_tasks(rows, ["k"], 1000, rows_per_task=20)
    assert dealt.rdd.getNumPartitions() == 50
    plan = dealt.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and dealt.groupBy("k").count().count() == 300
    panel = panel_of([{"inforce_mm": m, "driver_no": d} for m in (1, 2) for d in ("01", "02", "02", None)])
    for out in (quality.duplicates(panel), lookups.exposure_anomalies(panel), lifecycle.policy_month_rollup(panel)):
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert quality.duplicates(panel).collect()[0].duplicate_records == 2
    assert sorted((r.n, r.driver_count, r.vehicle_count) for r in lifecycle.policy_month_rollup(panel).collect()) == [(4, 2, 1)] * 2
