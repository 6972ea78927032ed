"""Panel construction, rating, assignment, events and reconciliation."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from monthmark.functions.columns import age_at, half_up, named_factor, padded, step_factor
from monthmark.operators import aggregates as agg
from monthmark.operators import assignment as asg
from monthmark.operators import events as ev
from monthmark.operators import lifecycle, lookups
from monthmark.operators import panel as pn
from monthmark.operators import rating as rt
from monthmark.operators import reconcile as rec
from monthmark.params import factor_table, load_params
from monthmark.plans.catalog.fragments import half_up as up
from monthmark.plans.catalog.fragments import money_mean
from monthmark.plans.fixtures import FIXTURE_PARAMS
from monthmark.plans.oracle_views import view
from monthmark.plans.registry import query
from monthmark.sources.staging import scratch_path

P = FIXTURE_PARAMS


def case_named(column: str, factors: dict, default: float = 1.0) -> str:
    whens = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in factors.items())
    return f"(CASE {column} {whens} ELSE CAST({default} AS DOUBLE) END)"


def case_steps(column: str, steps: dict, default: float = 1.0) -> str:
    whens = " ".join(f"WHEN {column} >= {k} THEN CAST({steps[k]} AS DOUBLE)"
                     for k in sorted(steps, reverse=True))
    return f"(CASE {whens} ELSE CAST({default} AS DOUBLE) END)"


TYPE_F = case_named("vehicle_type", P.vehicle_factors)
ROLE_F = ("(CASE assignment_type WHEN 'primary' THEN CAST(1.0 AS DOUBLE) WHEN 'secondary' THEN "
          "CAST(0.5 AS DOUBLE) WHEN 'secondary_adult' THEN CAST(0.5 AS DOUBLE) "
          "ELSE CAST(1.0 AS DOUBLE) END)")


def rate_sql(age: str, year: str) -> str:
    return (f"CAST(1500.0 AS DOUBLE) * {TYPE_F} * {case_steps(age, P.age_factors)} * {ROLE_F} "
            f"* pow(CAST(1.05 AS DOUBLE), {year} - 1995)")


# The reference form: every month of the run against every interval that covers its end.
view("ov_spine", """
SELECT CAST(year(d) AS INT) AS inforce_yy, CAST(month(d) AS INT) AS inforce_mm,
  last_day(CAST(d AS DATE)) AS me
FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS d) x
""")
view("ov_cancel", """
SELECT family_id, min(date) AS cancel_date FROM fx_changes_log
WHERE change_type = 'policy_cancellation' GROUP BY family_id
""", ("fx_changes_log",))
view("ov_inforce", """
SELECT s.inforce_yy, s.inforce_mm, s.me, p.policy_no AS policy, p.family_id, p.start_date,
  p.current_expiry_date AS policy_expiry_date
FROM ov_spine s CROSS JOIN fx_policies p LEFT JOIN ov_cancel c ON p.family_id = c.family_id
WHERE NOT (p.status = 'cancelled' AND c.cancel_date IS NOT NULL AND c.cancel_date <= s.me)
""", ("ov_spine", "fx_policies", "ov_cancel"))
view("ov_active", """
SELECT i.*, a.vehicle_no, a.driver_no, a.assignment_type, a.exposure_factor
FROM ov_inforce i JOIN fx_assignments a ON i.family_id = a.family_id
  AND a.effective_date <= i.me AND (a.end_date IS NULL OR i.me < a.end_date)
""", ("ov_inforce", "fx_assignments"))
view("ov_vehicled", """
SELECT a.*, v.vin AS vehicle_vin, v.vehicle_type, v.model_year FROM ov_active a
JOIN fx_vehicles v ON a.family_id = v.family_id AND a.vehicle_no = v.vehicle_no
  AND v.effective_date <= a.me AND (v.status = 'active' OR (v.status = 'removed'
  AND v.removal_date > a.me))
""", ("ov_active", "fx_vehicles"))
view("ov_built", f"""
SELECT inforce_yy, inforce_mm, policy, policy_expiry_date,
  CAST(datediff('day', start_date, me) AS INT) AS client_tenure_days, vehicle_no, vehicle_vin,
  vehicle_type, model_year, driver_no, license_no AS driver_license_no, driver_name, driver_type,
  assignment_type, exposure_factor, driver_age, premium_rate,
  {up('premium_rate * exposure_factor')} AS premium_paid
FROM (SELECT v.*, d.license_no, d.driver_name, d.driver_type, d.age_at_issuance AS driver_age,
        {up(rate_sql('d.age_at_issuance', 'v.inforce_yy'))} AS premium_rate
      FROM ov_vehicled v JOIN fx_drivers d ON v.family_id = d.family_id
        AND v.driver_no = d.driver_no AND d.effective_date <= v.me) x
""", ("ov_vehicled", "fx_drivers"))


def _built(t):
    return pn.build_panel(t.policies, t.vehicles, t.drivers, t.assignments, t.changes_log, P)


# --- panel ---------------------------------------------------------------------------------

@query("panel_build", "SELECT * FROM ov_built")
def _(t):
    return _built(t)


@query("panel_tenure", """
SELECT policy, inforce_yy, inforce_mm, CAST(datediff('day', start_date, me) AS INT)
  AS client_tenure_days FROM ov_inforce""")
def _(t):
    held = pn.policy_ranges(t.policies, t.changes_log, P).select(
        F.col("policy_no").alias("policy"), "start_date",
        F.lit(pn.spine_bounds(P)[0]).alias("lo"), F.col("policy_hi").alias("hi"))
    return pn.tenure_days(pn.explode_months(held)).drop("start_date")


@query("join_cancelled_anti", "SELECT policy, inforce_yy, inforce_mm FROM ov_inforce")
def _(t):
    held = pn.policy_ranges(t.policies, t.changes_log, P).select(
        F.col("policy_no").alias("policy"), F.lit(pn.spine_bounds(P)[0]).alias("lo"),
        F.col("policy_hi").alias("hi"))
    return pn.explode_months(held)


@query("join_first_cancel", "SELECT * FROM ov_cancel")
def _(t):
    return pn.first_cancellations(t.changes_log)


ACTIVE = ["policy", "family_id", "inforce_yy", "inforce_mm", "vehicle_no", "driver_no",
          "assignment_type", "exposure_factor"]


@query("join_panel_interval", f"SELECT {', '.join(ACTIVE)} FROM ov_active")
def _(t):
    ranged = pn.in_force_assignments(t.policies, t.changes_log, t.assignments, P)
    return pn.explode_months(ranged).select(*ACTIVE)


@query("join_vehicle_asof", f"""
SELECT {', '.join(ACTIVE)}, vehicle_vin AS vin, vehicle_type, model_year FROM ov_vehicled""")
def _(t):
    ranged = pn.in_force_assignments(t.policies, t.changes_log, t.assignments, P)
    return pn.explode_months(pn.with_vehicle(ranged, t.vehicles, P)).select(
        *ACTIVE, "vin", "vehicle_type", "model_year")


@query("join_driver_asof", f"""
SELECT {', '.join('a.' + c for c in ACTIVE)}, d.driver_name, d.driver_type,
  d.age_at_issuance AS driver_age FROM ov_active a
JOIN fx_drivers d ON a.family_id = d.family_id AND a.driver_no = d.driver_no
  AND d.effective_date <= a.me""")
def _(t):
    ranged = pn.in_force_assignments(t.policies, t.changes_log, t.assignments, P)
    return pn.explode_months(pn.with_driver(ranged, t.drivers)).select(
        *ACTIVE, "driver_name", "driver_type", "driver_age")


# --- joins of the reports --------------------------------------------------------------------

AVERAGES = f"""
WITH s AS (SELECT inforce_yy, inforce_mm, count(DISTINCT policy) AS inforce_count,
    {money_mean('premium_paid')} AS avg_premium, avg(driver_age) AS avg_driver_age
  FROM fx_panel GROUP BY inforce_yy, inforce_mm),
c AS (SELECT inforce_yy, inforce_mm, avg(d) AS avg_driver_count, avg(v) AS avg_vehicle_count FROM
  (SELECT inforce_yy, inforce_mm, policy, count(DISTINCT driver_no) AS d,
     count(DISTINCT vehicle_no) AS v FROM fx_panel GROUP BY 1, 2, 3) x GROUP BY 1, 2),
m AS (SELECT * FROM s JOIN c USING (inforce_yy, inforce_mm))
"""


@query("join_monthly_avg", AVERAGES + "SELECT * FROM m")
def _(t):
    return lifecycle.monthly_averages(t.panel)


@query("join_monthly_pivot", AVERAGES + ", pv AS (SELECT inforce_yy, inforce_mm, " + ", ".join(
    f"count(*) FILTER (WHERE vehicle_type = '{v}') / count(vehicle_type) * 100 "
    f"AS \"vehicle_type_{v}_pct\""
    for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM fx_panel GROUP BY 1, 2) SELECT * FROM m LEFT JOIN pv USING (inforce_yy, inforce_mm)")
def _(t):
    return lifecycle.monthly_with_shares(t.panel, t.panel_types)


@query("join_first_appearance", AVERAGES + """,
fp AS (SELECT policy, min(inforce_yy * 100 + inforce_mm) AS p FROM fx_panel GROUP BY policy)
SELECT m.*, (SELECT count(*) FROM fp WHERE p = inforce_yy * 100 + inforce_mm) AS new_policies FROM m""")
def _(t):
    return lifecycle.monthly_with_new(t.panel)


@query("join_latest_month", """
SELECT policy, inforce_yy, inforce_mm, vehicle_vin, premium_paid FROM fx_panel p
WHERE inforce_yy * 100 + inforce_mm = (SELECT max(inforce_yy * 100 + inforce_mm) FROM fx_panel q
  WHERE q.policy = p.policy)""")
def _(t):
    return rec.latest_month(t.panel).select("policy", "inforce_yy", "inforce_mm", "vehicle_vin",
                                            "premium_paid")


@query("join_policy_family", """
SELECT p.policy_no, a.* FROM fx_assignments a JOIN fx_policies p USING (family_id)""")
def _(t):
    return lookups.policy_assignments(t.policies, t.assignments)


RATING = """
SELECT a.family_id, a.vehicle_no, a.driver_no, a.assignment_type, a.exposure_factor,
  a.effective_date, a.status, v.vehicle_type, v.model_year, d.driver_type, d.age,
  d.age_at_issuance
FROM fx_assignments a JOIN fx_vehicles v USING (family_id, vehicle_no)
JOIN fx_drivers d USING (family_id, driver_no)"""
RATING_COLUMNS = ["family_id", "vehicle_no", "driver_no", "assignment_type", "exposure_factor",
                  "effective_date", "status", "vehicle_type", "model_year", "driver_type", "age",
                  "age_at_issuance"]


def _rating_rows(t):
    return rt.rating_rows(t.assignments, t.vehicles, t.drivers)


@query("join_rating", RATING)
def _(t):
    return _rating_rows(t).select(*RATING_COLUMNS)


@query("join_factor_equi", f"""
SELECT policy, vehicle_vin, vehicle_type, {TYPE_F} AS vehicle_factor FROM fx_panel""")
def _(t):
    table = factor_table(t.spark, P.vehicle_factors, "vehicle_type", "string")
    return rt.join_named_factor(t.panel, table, "vehicle_type", "vehicle_factor").select(
        "policy", "vehicle_vin", "vehicle_type", "vehicle_factor")


@query("join_factor_step", f"""
SELECT policy, vehicle_vin, driver_age, {case_steps('driver_age', P.age_factors)} AS age_factor
FROM fx_panel""")
def _(t):
    table = factor_table(t.spark, P.age_factors, "age", "int")
    return rt.join_step_factor(t.panel, table, "driver_age", "age_factor").select(
        "policy", "vehicle_vin", "driver_age", "age_factor")


@query("scan_params", f"""
SELECT {TYPE_F} AS vehicle_factor, {case_steps('driver_age', P.age_factors)} AS age_factor,
  count(*) AS record_count FROM fx_panel GROUP BY 1, 2""")
def _(t):
    path = scratch_path(t.spark, "params")
    text = json.dumps({"policies": {"premium": {"calculation": {
        "vehicle_type_factors": P.vehicle_factors, "driver_age_factors": P.age_factors}}}})
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    p = load_params(path, t.spark)
    return t.panel.groupBy(named_factor("vehicle_type", p.vehicle_factors).alias("vehicle_factor"),
                           step_factor("driver_age", p.age_factors).alias("age_factor")).agg(
                               agg.rows())


# --- rating ----------------------------------------------------------------------------------

@query("rate_assignment", f"""
SELECT policy, inforce_yy, inforce_mm, vehicle_vin, driver_license_no,
  {up(rate_sql('driver_age', 'inforce_yy'))} AS rate FROM fx_panel""")
def _(t):
    return t.panel.select("policy", "inforce_yy", "inforce_mm", "vehicle_vin",
                          "driver_license_no",
                          rt.assignment_rate(P, F.col("inforce_yy")).alias("rate"))


@query("rate_paid_panel", f"""
SELECT policy, inforce_yy, inforce_mm, vehicle_vin, driver_license_no, rate,
  {up('rate * exposure_factor')} AS paid FROM (SELECT *,
  {up(rate_sql('driver_age', 'inforce_yy'))} AS rate FROM fx_panel) x""")
def _(t):
    rated = t.panel.withColumn("rate", rt.assignment_rate(P, F.col("inforce_yy")))
    return rated.select("policy", "inforce_yy", "inforce_mm", "vehicle_vin", "driver_license_no",
                        "rate", rt.paid("rate", "exposure_factor").alias("paid"))


@query("rate_paid_stored", f"""
SELECT family_id, vehicle_no, driver_no, effective_date, annual_premium_paid,
  {up('annual_premium_paid / exposure_factor')} AS annual_premium_rate FROM (
  SELECT *, {up(rate_sql('age_at_issuance', 'year(effective_date)') + ' * exposure_factor')}
    AS annual_premium_paid FROM ({RATING}) r) x""")
def _(t):
    return rt.stored_premiums(_rating_rows(t).drop("annual_premium_paid"), P).select(
        "family_id", "vehicle_no", "driver_no", "effective_date", "annual_premium_paid",
        "annual_premium_rate")


DRIVER_TYPE_F = "CAST(1.0 AS DOUBLE)"
CALCULATED = f"""
SELECT p.policy_no, p.family_id, p.status, p.premium_paid AS stored_premium,
  {up('greatest(coalesce(r.amount, 0.0), 100.0)')} AS calculated_premium,
  coalesce(e.total_exposure, 0.0) AS total_exposure
FROM fx_policies p
LEFT JOIN (SELECT family_id, CAST(sum(CAST(round(exposure_factor * 10000) AS BIGINT)) AS DOUBLE)
    / 10000 AS total_exposure FROM fx_assignments
  WHERE status = 'active' AND exposure_factor > 0 GROUP BY family_id) e USING (family_id)
LEFT JOIN (SELECT family_id, sum(CAST(CAST(1500.0 AS DOUBLE) * exposure_factor * {TYPE_F}
    * {case_steps('age', P.age_factors)} * {DRIVER_TYPE_F} AS DECIMAL(28,10))) AS amount FROM ({RATING}) x
  WHERE status = 'active' AND exposure_factor > 0 GROUP BY family_id) r USING (family_id)
"""
view("ov_calculated", CALCULATED, ("fx_policies", "fx_assignments", "fx_vehicles", "fx_drivers"))


def _calculated(t):
    return rt.policy_premiums(t.policies, t.assignments, t.vehicles, t.drivers, P)


@query("rate_policy", "SELECT * FROM ov_calculated")
def _(t):
    return _calculated(t)


@query("rate_exposure_total", "SELECT policy_no, total_exposure FROM ov_calculated")
def _(t):
    return rt.policy_exposures(t.policies, t.assignments)


@query("rate_age_select", """
SELECT family_id, driver_no, age_at_issuance AS substitution_age, age AS new_driver_age
FROM fx_drivers""")
def _(t):
    return t.drivers.select("family_id", "driver_no",
                            rt.rating_age("vehicle_substitution").alias("substitution_age"),
                            rt.rating_age("new_driver").alias("new_driver_age"))


@query("rate_inflation", f"""
WITH RECURSIVE g AS (
  SELECT policy_no, status, premium_paid, 0 AS k FROM fx_policies
  UNION ALL
  SELECT policy_no, status, CASE WHEN status = 'active' THEN {up('premium_paid * 1.05')}
    ELSE premium_paid END, k + 1 FROM g WHERE k < 6)
SELECT policy_no, premium_paid FROM g WHERE k = 6""")
def _(t):
    return rt.yearly_increase(t.policies, P, 2001).select("policy_no", "premium_paid")


@query("rate_multi_vehicle_discount", """
WITH c AS (SELECT family_id, count(DISTINCT vehicle_no) AS active_vehicles FROM fx_vehicles
  WHERE status = 'active' GROUP BY family_id)
SELECT family_id, active_vehicles, CASE WHEN active_vehicles >= 4 THEN CAST(0.2 AS DOUBLE)
  WHEN active_vehicles = 3 THEN 0.15 WHEN active_vehicles = 2 THEN 0.1 ELSE 0.0 END AS discount
FROM c""")
def _(t):
    return rt.multi_vehicle_discount(t.vehicles, P)


@query("age_at_date", """
SELECT family_id, driver_no, CAST(date_part('year', age(DATE '2000-06-15', birthday)) AS INT)
  AS age_on_date FROM fx_drivers""")
def _(t):
    on = F.lit("2000-06-15").cast("date")
    return t.drivers.select("family_id", "driver_no", age_at("birthday", on).alias("age_on_date"))


# --- renewals and events -----------------------------------------------------------------------

CHAIN = """(SELECT family_id, policy_no, k, current_expiry_date + 365 * CAST(k AS INT) AS d
  FROM fx_policies, range(0, 10) r(k) WHERE status = 'active'
  AND current_expiry_date + 365 * CAST(k AS INT) <= DATE '2001-08-31')"""


@query("renewal_events", f"""
WITH c AS (SELECT *, min(CASE WHEN day(d) <> 1 THEN k ELSE 99 END) OVER (PARTITION BY policy_no)
  AS missed FROM {CHAIN} x)
SELECT 'policy_renewal' AS change_type, d AS date, family_id, policy_no, d AS old_expiry_date,
  d + 365 AS new_expiry_date, 'annual_renewal' AS reason FROM c WHERE k < missed""")
def _(t):
    return ev.renewals(t.policies, P)


@query("renewal_events_in_month", f"""
SELECT 'policy_renewal' AS change_type, CAST(date_trunc('month', d) AS DATE) AS date, family_id,
  policy_no, d AS old_expiry_date, d + 365 AS new_expiry_date, 'annual_renewal' AS reason
FROM {CHAIN} x""")
def _(t):
    return ev.renewals(t.policies, P, "in_month")


@query("renewal_driver_ages", f"""
WITH l AS (SELECT family_id, max(CAST(date_trunc('month', d) AS DATE)) AS d FROM {CHAIN} x
  GROUP BY family_id)
SELECT r.family_id, r.driver_no, CAST(CASE WHEN l.d IS NULL THEN r.age ELSE
    date_part('year', age(l.d, r.birthday)) END AS INT) AS age,
  CAST(CASE WHEN l.d IS NULL THEN r.age_at_issuance ELSE
    date_part('year', age(l.d, r.birthday)) END AS INT) AS age_at_issuance
FROM fx_drivers r LEFT JOIN l USING (family_id)""")
def _(t):
    return ev.renewed_drivers(t.drivers, ev.renewals(t.policies, P, "in_month")).select(
        "family_id", "driver_no", "age", "age_at_issuance")


def _untouched_vehicles(t):
    """The fixture's vehicles as they were before any removal."""
    return t.vehicles.withColumns({"status": F.lit("active"),
                                   "removal_date": F.lit(None).cast("date")})


REPLAYED = """
r AS (SELECT family_id, vehicle_no, min(date) AS gone FROM fx_changes_log
  WHERE change_type = 'vehicle_removal' GROUP BY family_id, vehicle_no)
"""


@query("events_close_intervals", f"""
WITH {REPLAYED}
SELECT a.family_id, a.vehicle_no, a.driver_no, a.effective_date,
  CASE WHEN a.status = 'active' AND r.gone >= a.effective_date THEN r.gone ELSE a.end_date END AS end_date,
  CASE WHEN a.status = 'active' AND r.gone >= a.effective_date THEN 'removed' ELSE a.status END AS status
FROM fx_assignments a LEFT JOIN r USING (family_id, vehicle_no)""")
def _(t):
    return ev.close_assignments(t.assignments, t.changes_log).select(
        "family_id", "vehicle_no", "driver_no", "effective_date", "end_date", "status")


@query("events_remove_vehicles", f"""
WITH {REPLAYED}
SELECT v.family_id, v.vehicle_no, CASE WHEN r.gone IS NULL THEN 'active' ELSE 'removed' END AS status,
  r.gone AS removal_date FROM fx_vehicles v LEFT JOIN r USING (family_id, vehicle_no)""")
def _(t):
    return ev.remove_vehicles(_untouched_vehicles(t), t.changes_log).select(
        "family_id", "vehicle_no", "status", "removal_date")


# The vehicles of a cancelled policy all leave on the day it was cancelled.
LEFT = f"""
{REPLAYED.rstrip()},
x AS (SELECT v.family_id, v.vehicle_no, least(r.gone, c.cancel_date) AS gone FROM fx_vehicles v
  LEFT JOIN r USING (family_id, vehicle_no) LEFT JOIN ov_cancel c USING (family_id)),
e AS (SELECT family_id, max(gone) AS date, arg_max(vehicle_no, (gone, vehicle_no)) AS vehicle_no
  FROM x GROUP BY family_id HAVING count(*) = count(gone))
"""


def _emptied(t):
    leaves = (t.changes_log.where("change_type = 'policy_cancellation'").drop("vehicle_no")
              .join(t.vehicles.select("family_id", "vehicle_no"), "family_id")
              .withColumn("change_type", F.lit("vehicle_removal")))
    return ev.remove_vehicles(_untouched_vehicles(t), ev.union_logs(t.changes_log, leaves))


@query("events_cancel_empty", f"""
WITH {LEFT}
SELECT p.policy_no, CASE WHEN e.family_id IS NULL THEN 'active' ELSE 'cancelled' END AS status
FROM fx_policies p LEFT JOIN e USING (family_id)""")
def _(t):
    policies = t.policies.withColumn("status", F.lit("active"))
    return ev.cancel_empty(policies, _emptied(t)).select("policy_no", "status")


@query("events_cancellations", f"""
WITH {LEFT}
SELECT 'policy_cancellation' AS change_type, date, family_id, vehicle_no,
  'all_vehicles_removed' AS reason FROM e""")
def _(t):
    return ev.cancellation_events(_emptied(t))


def _substitutions(t):
    """Each later order of a vehicle as a substitution by that order's first part."""
    daily = t.base.groupBy("family_id", "vehicle_no", F.col("od").alias("date")).agg(
        F.min("l_partkey").alias("part"), F.min("p_type").alias("vehicle_type"),
        (F.lit(1970) + F.min("p_size")).cast("int").alias("model_year"))
    return daily.withColumn("vin", F.concat(F.lit("VIN"), padded("part", 14))).drop("part")


@query("events_substitute", """
WITH d AS (SELECT family_id, vehicle_no, od AS valid_from,
    concat('VIN', lpad(CAST(min(l_partkey) AS VARCHAR), CAST(greatest(length(CAST(min(l_partkey) AS VARCHAR)), 14) AS INTEGER), '0')) AS vin,
    min(p_type) AS vehicle_type, CAST(1970 + min(p_size) AS INT) AS model_year
  FROM fx_base GROUP BY family_id, vehicle_no, od)
SELECT *, lead(valid_from) OVER (PARTITION BY family_id, vehicle_no ORDER BY valid_from) AS valid_to
FROM d""")
def _(t):
    return ev.vehicle_versions(t.vehicles, _substitutions(t))


@query("events_substitute_current", """
SELECT family_id, vehicle_no, max(od) AS valid_from,
  arg_max(vin, od) AS vin, arg_max(vehicle_type, od) AS vehicle_type,
  arg_max(model_year, od) AS model_year FROM (
  SELECT family_id, vehicle_no, od, concat('VIN', lpad(CAST(min(l_partkey) AS VARCHAR), CAST(greatest(length(CAST(min(l_partkey) AS VARCHAR)), 14) AS INTEGER), '0')) AS vin,
    min(p_type) AS vehicle_type, CAST(1970 + min(p_size) AS INT) AS model_year
  FROM fx_base GROUP BY family_id, vehicle_no, od) d GROUP BY family_id, vehicle_no""")
def _(t):
    return ev.current_vehicles(ev.vehicle_versions(t.vehicles, _substitutions(t)))


# --- assignment --------------------------------------------------------------------------------

RANKED = """
d AS (SELECT family_id, driver_no, age, row_number() OVER (PARTITION BY family_id
    ORDER BY CASE driver_type WHEN 'adult' THEN 0 ELSE 1 END, driver_no) - 1 AS ds,
    count(*) OVER (PARTITION BY family_id) AS nd FROM fx_drivers),
v AS (SELECT family_id, vehicle_no, row_number() OVER (PARTITION BY family_id ORDER BY vehicle_no) - 1
    AS vs, count(*) OVER (PARTITION BY family_id) AS nv FROM fx_vehicles),
n AS (SELECT family_id, max(nv) AS nv, max(nd) AS nd FROM d JOIN v USING (family_id) GROUP BY family_id)
"""
NUMBER = "'ASS' || lpad(CAST({0} AS VARCHAR), CAST(greatest(length(CAST({0} AS VARCHAR)), 8) AS INTEGER), '0')"


@query("assign_initial", f"""
WITH {RANKED},
s AS (SELECT d.family_id, d.driver_no, d.age, n.nv, n.nd,
    CASE WHEN n.nd > n.nv THEN (d.ds - n.nv) % n.nv ELSE 0 END AS vs,
    row_number() OVER (PARTITION BY d.family_id ORDER BY d.ds) AS pos
  FROM d JOIN n USING (family_id)
  WHERE (n.nd > n.nv AND d.ds >= n.nv) OR (n.nd = n.nv AND d.age <= 24))
SELECT v.family_id, {NUMBER.format('v.vs + 1')} AS assignment_id, v.vehicle_no, d.driver_no,
  'primary' AS assignment_type, CAST(CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.family_id = v.family_id
    AND s.vs = v.vs AND (s.age > 24 OR s.nd = s.nv)) THEN 0.6 ELSE 1.0 END AS DOUBLE) AS exposure_factor
FROM v JOIN n USING (family_id) JOIN d ON d.family_id = v.family_id
  AND d.ds = CASE WHEN v.vs < n.nd THEN v.vs ELSE 0 END
UNION ALL
SELECT s.family_id, {NUMBER.format('s.nv + s.pos')}, v.vehicle_no, s.driver_no,
  CASE WHEN s.age <= 24 THEN 'secondary_teen' ELSE 'secondary_adult' END,
  CASE WHEN s.age <= 24 THEN 0.35 ELSE 0.5 END
FROM s JOIN v ON s.family_id = v.family_id AND s.vs = v.vs""")
def _(t):
    return asg.initial_assignments(t.vehicles, t.drivers, P)


YOUNGEST = """
d AS (SELECT family_id, driver_no, age, row_number() OVER (PARTITION BY family_id
    ORDER BY age, driver_no) - 1 AS ds, count(*) OVER (PARTITION BY family_id) AS nd FROM fx_drivers),
v AS (SELECT family_id, vehicle_no, row_number() OVER (PARTITION BY family_id ORDER BY vehicle_no) - 1
    AS vs, count(*) OVER (PARTITION BY family_id) AS nv FROM fx_vehicles WHERE status = 'active'),
m AS (SELECT v.*, d.nd, d.driver_no FROM v JOIN d ON v.family_id = d.family_id
    AND d.ds = v.vs % d.nd),
s AS (SELECT m.family_id, m.vehicle_no, m.vs, d.driver_no, d.age FROM m JOIN d
    ON m.family_id = d.family_id AND d.ds = CASE WHEN m.vs = 0 THEN 1 ELSE 0 END
  WHERE m.nd > m.nv),
r AS (SELECT m.family_id, m.vehicle_no, m.driver_no, 'primary' AS assignment_type,
    CAST(CASE WHEN s.age > 24 THEN 0.6 ELSE 1.0 END AS DOUBLE) AS exposure_factor
  FROM m LEFT JOIN s ON m.family_id = s.family_id AND m.vs = s.vs
  UNION ALL
  SELECT family_id, vehicle_no, driver_no,
    CASE WHEN age <= 24 THEN 'secondary_teen' ELSE 'secondary_adult' END,
    CASE WHEN age <= 24 THEN 0.35 ELSE 0.5 END FROM s)
"""


@query("assign_reassign", f"""
WITH {YOUNGEST}
SELECT concat('ASS', family_id, vehicle_no, driver_no) AS assignment_id, *,
  DATE '2001-09-01' AS effective_date, CAST(NULL AS DATE) AS end_date, 'active' AS status FROM r""")
def _(t):
    return asg.reassign(t.vehicles, t.drivers, P, date(2001, 9, 1))


@query("assign_reassign_closed", """
SELECT family_id, vehicle_no, driver_no, effective_date,
  CASE WHEN status = 'active' AND family_id IN (SELECT family_id FROM fx_vehicles WHERE status = 'active')
    THEN DATE '2001-09-01' ELSE end_date END AS end_date,
  CASE WHEN status = 'active' AND family_id IN (SELECT family_id FROM fx_vehicles WHERE status = 'active')
    THEN 'removed' ELSE status END AS status FROM fx_assignments""")
def _(t):
    on = date(2001, 9, 1)
    new = asg.reassign(t.vehicles, t.drivers, P, on)
    return asg.close_for_reassignment(t.assignments, new, on).select(
        "family_id", "vehicle_no", "driver_no", "effective_date", "end_date", "status")


@query("assign_reassign_premiums", f"""
WITH {YOUNGEST}
SELECT family_id, vehicle_no, driver_no, exposure_factor, annual_premium_paid,
  {up('annual_premium_paid / exposure_factor')} AS annual_premium_rate FROM (
  SELECT r.*, {up(rate_sql('age_at_issuance', '2001') + ' * r.exposure_factor')} AS annual_premium_paid
  FROM r JOIN fx_vehicles USING (family_id, vehicle_no) JOIN fx_drivers USING (family_id, driver_no)) x""")
def _(t):
    new = asg.reassign(t.vehicles, t.drivers, P, date(2001, 9, 1))
    return asg.with_stored_premiums(new, t.vehicles, t.drivers, P).select(
        "family_id", "vehicle_no", "driver_no", "exposure_factor", "annual_premium_paid",
        "annual_premium_rate")


@query("assign_validate", """
WITH a AS (SELECT * FROM fx_assignments WHERE status = 'active'),
pv AS (SELECT family_id, vehicle_no, count(*) FILTER (WHERE assignment_type = 'primary') AS primaries,
  count(DISTINCT driver_no) AS people FROM a GROUP BY 1, 2),
v AS (SELECT family_id, vehicle_no, coalesce(primaries, 0) AS primaries, coalesce(people, 0) AS people
  FROM (SELECT family_id, vehicle_no FROM fx_vehicles WHERE status = 'active') x
  LEFT JOIN pv USING (family_id, vehicle_no))
SELECT family_id, 'vehicle' AS subject, vehicle_no AS subject_no, 'one_primary' AS rule,
  primaries AS observed FROM v WHERE primaries <> 1
UNION ALL SELECT family_id, 'vehicle', vehicle_no, 'max_drivers', people FROM v WHERE people > 3
UNION ALL SELECT family_id, 'driver', driver_no, 'driver_assigned', 0 FROM fx_drivers d
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.family_id = d.family_id AND a.driver_no = d.driver_no)
UNION ALL SELECT family_id, 'driver', driver_no, 'no_unassigned', 1 FROM a
  WHERE assignment_type = 'unassigned'""")
def _(t):
    return asg.assignment_violations(t.assignments, t.vehicles, t.drivers, P)


# --- reconciliation ----------------------------------------------------------------------------

LATEST = f"""
WITH l AS (SELECT *, inforce_yy * 100 + inforce_mm AS p, max(inforce_yy * 100 + inforce_mm)
  OVER (PARTITION BY policy) AS lp FROM fx_panel)
SELECT policy, lp AS latest_period, {money_mean('CASE WHEN p = lp THEN premium_paid END')}
    AS inforce_premium,
  CAST(sum(CASE WHEN p = lp THEN CAST(round(premium_paid * 100) AS BIGINT) END) AS DOUBLE) / 100
    AS inforce_premium_total,
  CAST(sum(CASE WHEN p = lp THEN CAST(round(exposure_factor * 10000) AS BIGINT) END) AS DOUBLE) / 10000
    AS current_exposure,
  count(*) FILTER (WHERE p = lp) AS records_in_latest_month,
  count(DISTINCT inforce_yy) AS months_inforce, count(DISTINCT p) AS months_observed
FROM l GROUP BY policy, lp"""
view("ov_latest", LATEST, ("fx_panel",))


@query("agg_inforce_latest", "SELECT * FROM ov_latest")
def _(t):
    return rec.inforce_latest(t.panel)


COMPARED = """
SELECT coalesce(c.policy_no, o.policy) AS policy, coalesce(family_id, 'N/A') AS family_id,
  coalesce(status, 'unknown') AS status, coalesce(calculated_premium, 0.0) AS calculated_premium,
  coalesce(stored_premium, 0.0) AS stored_premium, coalesce(inforce_premium, 0.0) AS inforce_premium,
  coalesce(total_exposure, 0.0) AS policy_exposure, coalesce(current_exposure, 0.0) AS inforce_exposure,
  coalesce(months_inforce, 0) AS months_inforce
FROM {calc} c FULL JOIN {obs} o ON c.policy_no = o.policy"""
view("ov_sources", COMPARED.format(calc="ov_calculated", obs="ov_latest"),
     ("ov_calculated", "ov_latest"))
view("ov_compared", """
SELECT *, status = 'active' AND premium_diff > 0.01 AS has_premium_discrepancy,
  status = 'active' AND exposure_diff > 0.01 AS has_exposure_discrepancy,
  status = 'active' AND stored_vs_calculated_diff > 0.01 AS has_stored_discrepancy
FROM (SELECT *,
  CASE WHEN inforce_premium > 0 THEN abs(calculated_premium - inforce_premium) ELSE 0 END AS premium_diff,
  CASE WHEN inforce_exposure > 0 THEN abs(policy_exposure - inforce_exposure) ELSE 0 END AS exposure_diff,
  abs(stored_premium - calculated_premium) AS stored_vs_calculated_diff FROM ov_sources) s
""", ("ov_sources",))


def _compared(t):
    return rec.compare(_calculated(t), rec.inforce_latest(t.panel), P)


@query("join_source_compare", "SELECT * FROM ov_sources")
def _(t):
    return rec.compare_sources(_calculated(t), rec.inforce_latest(t.panel))


@query("rec_compare", "SELECT * FROM ov_compared")
def _(t):
    return _compared(t)


BAD = "has_premium_discrepancy OR has_exposure_discrepancy OR has_stored_discrepancy"


@query("rec_discrepancies", f"SELECT * FROM ov_compared WHERE {BAD}")
def _(t):
    return rec.discrepancies(_compared(t))


@query("rec_discrepancy_counts", f"""
SELECT count(*) AS total_policies, count(*) FILTER (WHERE {BAD}) AS policies_with_discrepancies,
  count(*) FILTER (WHERE {BAD}) / count(*) * 100 AS discrepancy_rate,
  count(*) FILTER (WHERE has_premium_discrepancy) AS premium_discrepancies,
  count(*) FILTER (WHERE has_exposure_discrepancy) AS exposure_discrepancies,
  count(*) FILTER (WHERE has_stored_discrepancy) AS stored_discrepancies FROM ov_compared""")
def _(t):
    return rec.discrepancy_counts(_compared(t))


@query("topk_discrepancies", f"""
SELECT policy, family_id, premium_diff, exposure_diff, premium_diff + exposure_diff AS total_diff
FROM ov_compared WHERE {BAD} ORDER BY total_diff DESC, policy LIMIT 10""")
def _(t):
    return rec.top_discrepancies(_compared(t)).select("policy", "family_id", "premium_diff",
                                                      "exposure_diff", "total_diff")


SUMMARY = ("calculated_premium", "stored_premium", "inforce_premium", "policy_exposure",
           "inforce_exposure")


@query("rec_summary", "SELECT " + ", ".join(
    f"round(avg({c}), 4) AS avg_{c}" for c in SUMMARY) + " FROM ov_compared")
def _(t):
    return agg.round_columns(rec.compare_summary(_compared(t)), [f"avg_{c}" for c in SUMMARY])


EARNED = up("CAST(sum(CAST(round(premium_paid * 100) AS BIGINT)) AS DOUBLE) / 12 / 100")


@query("agg_annual_earned", f"""
SELECT policy, inforce_yy, {EARNED} AS annual_earned FROM fx_panel GROUP BY policy, inforce_yy""")
def _(t):
    return rec.annual_earned(t.panel)


def _annual(year: int, extra: str = "") -> str:
    return f"""SELECT p.policy_no AS policy, coalesce(a.paid, 0.0) AS annual_premium FROM fx_policies p
LEFT JOIN (SELECT family_id, CAST(sum(CAST(round(annual_premium_paid * 100) AS BIGINT)) AS DOUBLE) / 100
  AS paid FROM fx_assignments WHERE status = 'active' AND effective_date <= DATE '{year}-12-31' {extra}
  GROUP BY family_id) a USING (family_id)"""


@query("agg_assignment_annual", _annual(2000))
def _(t):
    return rec.assignment_annual(t.policies, t.assignments, 2000)


@query("agg_assignment_annual_overlap",
       _annual(2000, "AND (end_date IS NULL OR end_date > DATE '2000-01-01')"))
def _(t):
    return rec.assignment_annual(t.policies, t.assignments, 2000, "overlap")


BOTH = f"""
e AS (SELECT policy, {EARNED} AS e FROM fx_panel WHERE inforce_yy = 2001 GROUP BY policy),
s AS ({_annual(2001)}),
b AS (SELECT policy, e, coalesce(annual_premium, 0.0) AS a, CASE WHEN annual_premium > 0
  THEN (e - annual_premium) / annual_premium * 100 END AS pct FROM e LEFT JOIN s USING (policy))
"""


@query("rec_aggregate_year", f"""
WITH {BOTH},
g AS (SELECT count(*) AS total_policies,
    CAST(sum(CAST(round(e * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_inforce_premium,
    CAST(sum(CAST(round(a * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_assignment_premium,
    count(*) FILTER (WHERE pct = 0) AS perfect_matches,
    count(*) FILTER (WHERE abs(pct) <= 1) AS within_1pct,
    count(*) FILTER (WHERE abs(pct) <= 5) AS within_5pct FROM b),
f AS (SELECT *, round(total_assignment_premium - total_inforce_premium, 2) AS total_difference FROM g)
SELECT *, total_difference / total_inforce_premium * 100 AS aggregate_pct_difference,
  within_1pct / total_policies * 100 AS match_rate_1pct,
  abs(total_difference / total_inforce_premium * 100) <= 1.0 AS success FROM f""")
def _(t):
    return rec.reconcile_year(t.panel, t.policies, t.assignments, 2001)


@query("rec_verdict", f"""
WITH {BOTH}
SELECT policy, e AS annual_earned, a AS annual_premium, pct AS pct_difference,
  CASE WHEN pct IS NULL THEN NULL WHEN abs(pct) <= 0.01 THEN 'perfect'
    WHEN abs(pct) <= 1.0 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS verdict FROM b""")
def _(t):
    return rec.policy_verdicts(t.panel, t.policies, t.assignments, 2001)


@query("agg_assignment_stats", f"""
WITH a AS (SELECT *, {up('annual_premium_paid / exposure_factor')} AS annual_premium_rate
  FROM fx_assignments)
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
  count(*) FILTER (WHERE status = 'removed') AS removed, min(annual_premium_rate) AS min_rate,
  max(annual_premium_rate) AS max_rate, {money_mean('annual_premium_rate')} AS mean_rate,
  min(annual_premium_paid) AS min_paid, max(annual_premium_paid) AS max_paid,
  {money_mean('annual_premium_paid')} AS mean_paid FROM a""")
def _(t):
    rated = t.assignments.withColumn("annual_premium_rate", half_up(
        F.col("annual_premium_paid") / F.col("exposure_factor")))
    return agg.assignment_stats(rated)

