"""Sources, sinks and report runs: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmark.operators import aggregates as agg
from monthmark.operators import changes as ch
from monthmark.operators import events as ev
from monthmark.plans import jobs
from monthmark.plans.catalog.aggregate_queries import DISTRIBUTION, TEMPORAL, _as_doubles
from monthmark.plans.fixtures import FIXTURE_PARAMS
from monthmark.plans.registry import query
from monthmark.sources import readers, writers
from monthmark.sources.staging import scratch_path

P = FIXTURE_PARAMS


def _csv_panel(t) -> str:
    return writers.write_panel(t.panel, scratch_path(t.spark, "panel_csv"))


@query("scan_panel", "SELECT * FROM fx_panel")
def _(t):
    return readers.scan_panel(t.spark, _csv_panel(t))


@query("scan_panel_dir", """
SELECT policy, inforce_yy, inforce_mm, vehicle_vin, premium_paid, true AS has_file FROM fx_panel""")
def _(t):
    out = readers.scan_panel_dir(t.spark, _csv_panel(t))
    return out.select("policy", "inforce_yy", "inforce_mm", "vehicle_vin", "premium_paid",
                      F.col("source_file").startswith("part-").alias("has_file"))


MASTER_ROWS = """
SELECT 'policies' AS tbl, family_id, policy_no AS no, status, start_date AS d FROM fx_policies
UNION ALL SELECT 'vehicles', family_id, vehicle_no, status, removal_date FROM fx_vehicles
UNION ALL SELECT 'drivers', family_id, driver_no, status, birthday FROM fx_drivers
UNION ALL SELECT 'assignments', family_id, assignment_id, status, end_date FROM fx_assignments
UNION ALL SELECT 'changes_log', family_id, vehicle_no, reason, date FROM fx_changes_log"""


def _master_rows(tables):
    cols = {"policies": ("policy_no", "status", "start_date"),
            "vehicles": ("vehicle_no", "status", "removal_date"),
            "drivers": ("driver_no", "status", "birthday"),
            "assignments": ("assignment_id", "status", "end_date"),
            "changes_log": ("vehicle_no", "reason", "date"),
            "families": ("family_type", "status", "start_date")}
    out = None
    for name, df in tables.items():
        no, status, d = cols[name]
        part = df.select(F.lit(name).alias("tbl"), "family_id", F.col(no).alias("no"),
                         F.col(status).alias("status"), F.col(d).alias("d"))
        out = part if out is None else out.unionByName(part)
    return out


def _masters(t) -> dict:
    return {"policies": t.policies.drop("last_date"), "vehicles": t.vehicles,
            "drivers": t.drivers, "assignments": t.assignments, "changes_log": t.changes_log}


for _name in ("scan_masters", "sink_masters"):
    # There is no families file here: the reader gives an empty table for it.
    @query(_name, MASTER_ROWS)
    def _(t):
        folder = writers.write_masters(_masters(t), scratch_path(t.spark, "masters"))
        return _master_rows(readers.scan_masters(t.spark, folder))


@query("sink_csv", "SELECT driver_type, count(*) AS count FROM fx_panel GROUP BY driver_type")
def _(t):
    path = writers.write_csv(agg.value_counts(t.panel, "driver_type"),
                             scratch_path(t.spark, "csv"), single_file=True)
    return t.spark.read.option("header", True).schema("driver_type string, count long").csv(path)


@query("sink_sorted_panel", "SELECT * FROM ov_flagged")
def _(t):
    path = writers.write_sorted_panel(ch.flag_panel(t.panel, in_order=True), scratch_path(t.spark, "sorted"), in_order=True)
    return readers.scan_panel(t.spark, path)


for _name in ("sink_panel_full_sort", "sort_global_panel"):
    @query(_name, "SELECT * FROM fx_panel")
    def _(t):
        path = writers.write_sorted_panel(t.panel, scratch_path(t.spark, "full_sort"),
                                          writers.FULL_ORDER, "parquet")
        return readers.scan_panel(t.spark, path, "parquet")


@query("sink_partitioned_panel", """
SELECT policy, vehicle_vin, inforce_yy, inforce_mm, premium_paid FROM fx_panel""")
def _(t):
    path = writers.write_partitioned_panel(t.panel, scratch_path(t.spark, "by_month"))
    return readers.scan_panel(t.spark, path, "parquet").select(
        "policy", "vehicle_vin", "inforce_yy", "inforce_mm", "premium_paid")


@query("sink_report_tables", """
SELECT vehicle_type AS kind, count(*) AS record_count FROM fx_panel GROUP BY 1
UNION ALL SELECT driver_type, count(*) FROM fx_panel GROUP BY 1""")
def _(t):
    paths = writers.write_report_tables(
        {"vehicle_type_profiling": agg.type_profile(t.panel, "vehicle_type"),
         "driver_type_profiling": agg.type_profile(t.panel, "driver_type", with_age=True)},
        scratch_path(t.spark, "reports"))
    read = lambda n, c: t.spark.read.option("header", True).csv(paths[n]).select(
        F.col(c).alias("kind"), F.col("record_count").cast("long"))
    return read("vehicle_type_profiling", "vehicle_type").unionByName(
        read("driver_type_profiling", "driver_type"))


@query("sink_changes_log", like="set_union_log")
def _(t):
    path = scratch_path(t.spark, "log")
    writers.append_changes_log(t.changes_log, path)
    writers.append_changes_log(ev.renewals(t.policies, P, "in_month"), path)
    return readers.read_table(t.spark, path, writers.CHANGES_LOG).select(
        "change_type", "date", "family_id", "vehicle_no", "reason", "policy_no",
        "old_expiry_date", "new_expiry_date")


@query("cache_panel", f"""
SELECT inforce_yy, inforce_mm, {TEMPORAL} FROM fx_panel GROUP BY inforce_yy, inforce_mm""")
def _(t):
    path = scratch_path(t.spark, "cached_report")
    with writers.persisted(t.panel) as panel:
        agg.temporal_report(panel).write.parquet(path)
    return t.spark.read.parquet(path)


@query("job_flag_file", like="agg_change_summary")
def _(t):
    return jobs.flag_file(t.spark, _csv_panel(t), scratch_path(t.spark, "flagged"))


@query("job_distribution_report", DISTRIBUTION)
def _(t):
    paths = jobs.distribution_report(t.panel, scratch_path(t.spark, "distribution"))
    written = t.spark.read.option("header", True).csv(paths["monthly_distribution_summary"])
    whole = {"year": "int", "month": "int", "inforce_count": "long", "new_policies": "long",
             "cumulative_policy_count": "long", "renewed_policies": "long",
             "major_change_rows": "long", "major_change_policies": "long"}
    return _as_doubles(written.select(*[F.col(c).cast(whole.get(c, "double")).alias(c)
                                        for c in written.columns]))


@query("job_profiling_report", f"""
SELECT inforce_yy, inforce_mm, {TEMPORAL} FROM fx_panel GROUP BY inforce_yy, inforce_mm""")
def _(t):
    paths = jobs.profiling_report(t.panel, scratch_path(t.spark, "profiling"), P)
    return t.spark.read.option("header", True).schema(
        "inforce_yy int, inforce_mm int, record_count long, unique_policies long, "
        "unique_vehicles long, unique_drivers long, avg_premium double, total_premium double"
    ).csv(paths["monthly_profiling_summary"])


@query("job_reconcile", like="rec_compare")
def _(t):
    paths = jobs.reconcile(t.panel, _masters(t), scratch_path(t.spark, "reconcile"), P)
    return t.spark.read.parquet(paths["comparison"])


