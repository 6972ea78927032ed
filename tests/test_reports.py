"""Reports, quality, events, reconciliation and files on small inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from monthmark.functions.skew import in_ranges
from monthmark.operators import aggregates as agg
from monthmark.operators import events as ev
from monthmark.operators import lifecycle, lookups, quality
from monthmark.operators import reconcile as rec
from monthmark.operators.changes import changed_months, flag_panel
from monthmark.params import Params
from monthmark.plans import jobs
from monthmark.schema import (ASSIGNMENTS, CHANGES_LOG, DRIVERS, PANEL_COLUMNS, POLICIES,
                              VEHICLES)
from monthmark.sources import readers, writers
from tests.test_changes import month, random_rows
from tests.test_panel import table

P = Params()


def test_first_period_is_not_the_independent_minimum(panel_of):
    rows = month(2018, 11, ("01", "01")) + month(2019, 1, ("01", "01"))
    first = lambda **k: lifecycle.first_periods(panel_of(rows), **k).collect()[0].first_period
    assert first() == 201811
    assert first(independent=True) == 201801


def test_new_renewed_and_cumulative_add_up(panel_of):
    panel = panel_of(random_rows(11))
    nr = {r.period: r for r in lifecycle.new_renewed(panel).collect()}
    cum = {r.period: r.cumulative_policy_count for r in lifecycle.cumulative_policies(panel).collect()}
    assert sum(r.new_policies for r in nr.values()) == cum[max(cum)]
    assert all(r.new_policies + r.renewed_policies == r.inforce_count for r in nr.values())
    monthly = lifecycle.monthly_distribution(panel, changed_months(panel)).collect()
    assert {r.year * 100 + r.month: r.cumulative_policy_count for r in monthly} == cum
    flagged = lifecycle.monthly_distribution(flag_panel(panel)).collect()
    assert sorted(map(tuple, monthly)) == sorted(map(tuple, flagged))


def test_shares_add_up(panel_of):
    panel = panel_of(random_rows(12)).withColumn(
        "vehicle_type", F.when(F.col("driver_no") == "01", "SUV").otherwise("Sedan"))
    for r in agg.type_share_pivot(panel, ["SUV", "Sedan", "Wagon"]).collect():
        assert abs(r["vehicle_type_SUV_pct"] + r["vehicle_type_Sedan_pct"] - 100) < 1e-9
        assert r["vehicle_type_Wagon_pct"] == 0.0


def test_first_non_null_value(panel_of):
    rows = [{"vehicle_no": "01", "driver_no": "01", "premium_paid": None, "driver_age": 40},
            {"vehicle_no": "01", "driver_no": "02", "premium_paid": 7.0, "driver_age": 30}]
    row = agg.first_rows(panel_of(rows), ["premium_paid", "driver_age"]).collect()[0]
    assert (row.premium_paid, row.driver_age) == (7.0, 40)


def test_quality_of_dirty_rows(panel_of):
    rows = [{}, {}, {"vehicle_no": None}, {"premium_paid": None}, {"driver_age": 15},
            {"driver_age": 101}, {"premium_paid": -1.0}, {"model_year": 2025},
            {"client_tenure_days": -1}]
    panel = panel_of(rows)
    assert tuple(quality.consistency(panel, 2024).collect()[0]) == (1, 2, 1, 1)
    assert quality.inconsistent_rows(panel, 2024).count() == 5
    dup = quality.duplicates(panel).collect()[0]
    assert (dup.total_records, dup.duplicate_records) == (9, 1)
    nulls = {r.column_name: r.null_count for r in quality.null_counts(panel).collect()}
    assert nulls["vehicle_no"] == 1 and nulls["premium_paid"] == 1 and nulls["policy"] == 0


def test_only_rows_of_shared_hashes_are_compared_as_wholes(spark, panel_of, tmp_path, monkeypatch):
    odd = [{"premium_paid": 0.0}, {"premium_paid": -0.0}, {"premium_paid": float("nan")}, {"premium_paid": float("nan")},
           {"vehicle_no": None, "driver_no": "x"}, {"vehicle_no": "x", "driver_no": None}, {"vehicle_no": None, "driver_no": "x"}]
    panel_of([*odd, *({"policy": f"{i}"} for i in range(200)), *({"policy": "7"},) * 3]).write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    out = quality.duplicates(panel)
    assert tuple(out.collect()[0]) == (210, 6, 6 / 210 * 100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    wide = plan.index("RepartitionByExpression")
    assert plan.index("LeftSemi") > wide  # rows are picked before they are dealt
    # Different rows may share a hash.
    with monkeypatch.context() as m:
        m.setattr(quality.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
        assert tuple(quality.duplicates(panel).collect()[0]) == (210, 6, 6 / 210 * 100)
    # Too many of them to be sent to all tasks: whole rows are dealt once, not twice.
    monkeypatch.setattr(quality, "MOST_SHARED", 3)
    out = quality.duplicates(panel)
    assert tuple(out.collect()[0]) == (210, 6, 6 / 210 * 100)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_empty_panel(panel_of):
    empty = panel_of([])
    dup = quality.duplicates(empty).collect()[0]
    assert (dup.total_records, dup.duplicate_records, dup.duplicate_percentage) == (0, 0, None)
    assert {r.null_percentage for r in quality.null_counts(empty).collect()} == {None}
    assert lifecycle.monthly_distribution(empty, changed_months(empty)).count() == 0
    assert lifecycle.retention(empty).count() == 0
    assert quality.profile_overview(empty, 2024).count() > 0


def test_period_filters(panel_of):
    rows = [r for k in range(30) for r in month(2017 + k // 12, k % 12 + 1, ("01", "01"))]
    got = lookups.in_period_range(panel_of(rows), 201711, 201902)
    periods = {r.inforce_yy * 100 + r.inforce_mm for r in got.collect()}
    assert min(periods) == 201711 and max(periods) == 201902 and len(periods) == 16
    pair = lookups.month_pair(panel_of(rows), 2018, 1).collect()
    assert {(r.inforce_yy, r.inforce_mm) for r in pair} == {(2017, 12), (2018, 1)}


def test_exposure_anomalies(panel_of):
    rows = [{"policy": "a", "exposure_factor": 0.6},
            {"policy": "b", "exposure_factor": 1.0}, {"policy": "b", "driver_no": "02",
                                                      "assignment_type": "secondary_adult"},
            {"policy": "c", "exposure_factor": 1.0}]
    assert {r.policy for r in lookups.exposure_anomalies(panel_of(rows)).collect()} == {"a", "b"}


def test_renewal_chain_ends_with_a_missed_renewal(spark):
    rows = [{"policy_no": "1", "family_id": "F1", "status": "active",
             "current_expiry_date": date(2019, 1, 1)},
            {"policy_no": "2", "family_id": "F2", "status": "active",
             "current_expiry_date": date(2019, 1, 2)},
            {"policy_no": "3", "family_id": "F3", "status": "cancelled",
             "current_expiry_date": date(2019, 1, 1)}]
    p = table(spark, POLICIES, rows)
    exact = [(r.policy_no, r.old_expiry_date) for r in ev.renewals(p, P).collect()]
    # 365 days after 2020-01-01 is 2020-12-31, which is not a first of month.
    assert exact == [("1", date(2019, 1, 1)), ("1", date(2020, 1, 1))]
    every = ev.renewals(p, P, "in_month")
    assert {r.policy_no: r.n for r in every.groupBy("policy_no").agg(
        F.count("*").alias("n")).collect()} == {"1": 7, "2": 7}
    renewed = {r.policy_no: r.current_expiry_date
               for r in ev.renewed_policies(p, ev.renewals(p, P)).collect()}
    assert renewed == {"1": date(2020, 12, 31), "2": date(2019, 1, 2), "3": date(2019, 1, 1)}


def test_events_close_and_cancel(spark):
    v = table(spark, VEHICLES, [{"family_id": "A", "vehicle_no": "01", "status": "active"},
                                {"family_id": "A", "vehicle_no": "02", "status": "active"},
                                {"family_id": "B", "vehicle_no": "01", "status": "active"}])
    d = table(spark, DRIVERS, [{"family_id": "A", "driver_no": "01", "status": "active"},
                               {"family_id": "A", "driver_no": "02", "status": "active"}])
    a = table(spark, ASSIGNMENTS, [
        {"family_id": "A", "vehicle_no": "01", "driver_no": "01", "status": "active",
         "effective_date": date(2018, 1, 1)},
        {"family_id": "A", "vehicle_no": "01", "driver_no": "02", "status": "active",
         "effective_date": date(2018, 1, 1)},
        {"family_id": "A", "vehicle_no": "02", "driver_no": "02", "status": "active",
         "effective_date": date(2018, 9, 1)}])
    log = table(spark, CHANGES_LOG, [
        {"change_type": "vehicle_removal", "family_id": "A", "vehicle_no": "01", "date": date(2018, 5, 1)},
        {"change_type": "adult_removal", "family_id": "A", "driver_no": "02", "date": date(2018, 4, 1)},
        {"change_type": "policy_cancellation", "family_id": "B", "vehicle_no": "01",
         "date": date(2018, 6, 1)}])
    closed = {(r.vehicle_no, r.driver_no): (r.status, r.end_date)
              for r in ev.close_assignments(a, log).collect()}
    assert closed == {("01", "01"): ("removed", date(2018, 5, 1)),
                      ("01", "02"): ("removed", date(2018, 4, 1)),
                      ("02", "02"): ("active", None)}
    left = ev.remove_vehicles(v, log)
    assert {(r.family_id, r.vehicle_no): r.status for r in left.collect()} == {
        ("A", "01"): "removed", ("A", "02"): "active", ("B", "01"): "removed"}
    assert [(r.family_id, r.date) for r in ev.cancellation_events(left).collect()] == [
        ("B", date(2018, 6, 1))]
    assert {r.driver_no: r.status for r in ev.remove_drivers(d, log).collect()} == {
        "01": "active", "02": "removed"}


def test_tenure_reset(spark):
    p = table(spark, POLICIES, [{"family_id": "A", "start_date": date(2018, 1, 1)},
                                {"family_id": "B", "start_date": date(2018, 1, 1)}])
    log = table(spark, CHANGES_LOG, [
        {"change_type": "vehicle_substitution", "family_id": "A", "date": date(2018, 5, 1),
         "tenure_reset": True},
        {"change_type": "vehicle_substitution", "family_id": "B", "date": date(2018, 5, 1),
         "tenure_reset": False}])
    assert {r.family_id: r.tenure_from for r in ev.tenure_resets(p, log).collect()} == {
        "A": date(2018, 5, 1), "B": date(2018, 1, 1)}


def test_compare_one_sided_and_tolerance(spark):
    calc = spark.createDataFrame(
        [("1", "F1", "active", 100.0, 100.02, 1.0), ("2", "F2", "active", 100.0, 100.0, 1.0),
         ("3", "F3", "cancelled", 100.0, 500.0, 0.0)],
        "policy_no string, family_id string, status string, calculated_premium double, "
        "stored_premium double, total_exposure double")
    obs = spark.createDataFrame([("1", 100.0, 1.0, 1), ("4", 50.0, 1.0, 2)],
                                "policy string, inforce_premium double, current_exposure double, "
                                "months_inforce long")
    out = {r.policy: r for r in rec.compare(calc, obs, P).collect()}
    assert set(out) == {"1", "2", "3", "4"}
    assert out["1"].has_stored_discrepancy and not out["1"].has_premium_discrepancy
    assert out["2"].premium_diff == 0.0 and not out["2"].has_exposure_discrepancy
    assert not out["3"].has_stored_discrepancy and out["4"].status == "unknown"
    counts = rec.discrepancy_counts(rec.compare(calc, obs, P)).collect()[0]
    assert (counts.total_policies, counts.policies_with_discrepancies) == (4, 1)


# --- files -------------------------------------------------------------------------------

def test_csv_round_trip_keeps_zeros_and_reads_all_parts(spark, panel_of, tmp_path):
    panel = panel_of(random_rows(4)).repartition(3)
    path = writers.write_csv(panel, f"{tmp_path}/panel")
    back = readers.scan_panel(spark, path)
    assert back.columns == PANEL_COLUMNS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, panel.collect()))
    files = readers.scan_panel_dir(spark, path)
    assert files.count() == panel.count()
    assert files.select("source_file").distinct().count() > 1


def test_malformed_cells_become_null(spark, tmp_path):
    (tmp_path / "p.csv").write_text("policy,inforce_yy,inforce_mm,policy_expiry_date,premium_paid\n"
                                    "00000002,2018,x,not-a-date,1.5\n")
    row = readers.scan_panel(spark, f"{tmp_path}/p.csv").collect()[0]
    assert (row.policy, row.inforce_yy, row.inforce_mm) == ("00000002", 2018, None)
    assert row.policy_expiry_date is None and row.premium_paid == 1.5 and row.vehicle_no is None


def test_missing_master_is_empty(spark, tmp_path):
    tables = readers.scan_masters(spark, str(tmp_path))
    assert tables["vehicles"].count() == 0 and tables["vehicles"].schema == VEHICLES


@pytest.mark.parametrize("order", [writers.POLICY_ORDER, writers.FULL_ORDER])
def test_sorted_panel_is_in_order_over_files(spark, panel_of, tmp_path, order):
    panel = panel_of(random_rows(5, policies=40))
    path = writers.write_sorted_panel(panel, f"{tmp_path}/s", order, "parquet")
    parts = sorted(f for f in (tmp_path / "s").iterdir() if f.name.startswith("part-"))
    rows = [tuple(str(r[c]).rjust(4, "0") for c in order)
            for f in parts for r in spark.read.parquet(str(f)).collect()]
    assert rows == sorted(rows) and len(rows) == panel.count()
    assert path.endswith("/s")


def test_large_panel_is_sorted_in_as_many_tasks_as_rows_ask_for(spark, panel_of):
    panel = panel_of(random_rows(5, policies=40))
    n = panel.count()
    dealt = in_ranges(panel, ["policy", "vehicle_no", "driver_no", "inforce_mm"], panel, rows_per_task=n // 20)
    assert dealt.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.count() == n


def test_csv_panel_is_compressed_and_read_back(spark, panel_of, tmp_path):
    panel = panel_of(random_rows(5, policies=40))
    path = writers.write_sorted_panel(panel, f"{tmp_path}/c")
    assert {f.name.split(".", 1)[1] for f in (tmp_path / "c").iterdir() if f.name.startswith("part-")} == {"csv.gz"}
    key = lambda df: sorted(map(str, df.collect()))
    assert key(readers.scan_panel(spark, path)) == key(panel)


def test_log_appends_have_one_schema(spark, tmp_path):
    path = f"{tmp_path}/log"
    one = spark.createDataFrame([("vehicle_removal", date(2018, 1, 1), "F", "01")],
                                "change_type string, date date, family_id string, vehicle_no string")
    two = spark.createDataFrame([("policy_renewal", date(2018, 2, 1), "F", "0001")],
                                "change_type string, date date, family_id string, policy_no string")
    writers.append_changes_log(one, path)
    writers.append_changes_log(two, path)
    back = readers.read_table(spark, path, CHANGES_LOG).orderBy("date").collect()
    assert [(r.change_type, r.vehicle_no, r.policy_no) for r in back] == [
        ("vehicle_removal", "01", None), ("policy_renewal", None, "0001")]


def test_month_partitions_are_pruned(spark, panel_of, tmp_path):
    path = writers.write_partitioned_panel(panel_of(random_rows(6)), f"{tmp_path}/m")
    cut = lookups.in_period_range(readers.scan_panel(spark, path, "parquet"), 201811, 201902)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(inforce_yy" in plan.replace("#", "(#").replace("(#", "#") \
        or "PartitionFilters: [isnotnull" in plan
    assert cut.count() > 0


def same_as_written(spark, path, df):
    """The rows of a CSV folder are those of the table, by its own types."""
    plain = df.select(*[F.col(c).cast("string") for c in df.columns])
    back = spark.read.option("header", True).csv(path)
    assert back.columns == df.columns
    # An empty text is a null in these files.
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(key, back.collect())) == sorted(map(key, plain.collect()))


def test_distribution_job_writes_every_table(spark, panel_of, tmp_path):
    panel = panel_of([{**r, "vehicle_type": ["Sedan", "SUV"][i % 2], "premium_paid": 100.0 + i, "driver_age": 20 + i % 40}
                      for i, r in enumerate(random_rows(5))])
    changed = changed_months(panel)
    types = ["SUV", "Sedan", "Truck"]
    paths = jobs.distribution_report(panel, str(tmp_path), types=types)
    tables = jobs.distribution_tables(panel, changed, types)
    assert set(paths) == set(tables) and {"monthly_report", "change_split", "vehicle_type_shares"} <= set(paths)
    for name, df in tables.items():
        same_as_written(spark, paths[name], df)
    # The report's figures, worked out by hand from the rows.
    rows, flagged = panel.collect(), {tuple(r[c] for c in ("policy", "inforce_yy", "inforce_mm")) for r in changed.collect()}
    assert flagged
    report = {(r["year"], r["month"]): r for r in tables["monthly_report"].collect()}
    assert set(report) == {(r.inforce_yy, r.inforce_mm) for r in rows}
    for (y, m), got in report.items():
        mine = [r for r in rows if (r.inforce_yy, r.inforce_mm) == (y, m)]
        for t in types:
            share = 100 * sum(r.vehicle_type == t for r in mine) / len(mine)
            assert got[f"vehicle_type_{t}_pct"] == pytest.approx(share)
        first = {}
        for r in sorted(mine, key=lambda r: (r.vehicle_no, r.driver_no), reverse=True):
            first[r.policy] = r
        for flag, suffix in ((True, "with_changes"), (False, "without_changes")):
            ages = [r.driver_age for p, r in first.items() if ((p, y, m) in flagged) == flag]
            want = sum(ages) / len(ages) if ages else None
            assert got[f"avg_driver_age_{suffix}"] == (pytest.approx(want) if ages else None)


def test_distribution_job_without_changes_or_types(spark, panel_of, tmp_path):
    panel = panel_of(random_rows(6, policies=3, months=3))
    paths = jobs.distribution_report(panel, str(tmp_path), with_changes=False)
    assert "change_split" not in paths and "monthly_report" not in paths
    without = jobs.monthly_report(panel, None, ["Sedan"])
    assert without.count() == panel.select("inforce_yy", "inforce_mm").distinct().count()
    assert not [c for c in without.columns if c.endswith("_changes")]


def test_profiling_job_writes_every_table(spark, panel_of, tmp_path):
    panel = panel_of(random_rows(7, policies=4, months=3))
    paths = jobs.profiling_report(panel, str(tmp_path), P)
    same_as_written(spark, paths["profile"], quality.profile_overview(panel, P.as_of_year))
    same_as_written(spark, paths["monthly_profiling_summary"], agg.temporal_report(panel))
    same_as_written(spark, paths["vehicle_type_profiling"], agg.type_profile(panel, "vehicle_type"))
    same_as_written(spark, paths["driver_type_profiling"], agg.type_profile(panel, "driver_type", with_age=True))
