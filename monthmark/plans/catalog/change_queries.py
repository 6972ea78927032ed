"""Change detection, its windows, and lookups around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmark.operators import changes as ch
from monthmark.operators import lookups
from monthmark.plans.registry import query



def _changed(t):
    return ch.changed_months(t.panel).withColumn("major_change", F.lit(True))


FLAG_ROWS = ["policy", "inforce_yy", "inforce_mm", "vehicle_no", "driver_no", "premium_paid",
             "major_change"]

for _name in ("chg_assignment_set", "join_flag_back", "win_lag_set"):
    if _name == "win_lag_set":
        query(_name, "SELECT * FROM ov_flags")(
            lambda t: ch.policy_month_changes(t.panel).select(*ch.KEYS, "major_change"))
    else:
        query(_name, f"SELECT {', '.join(FLAG_ROWS)} FROM ov_flagged")(
            lambda t: ch.flag_panel(t.panel).select(*FLAG_ROWS))

CALENDAR = """
WITH s AS (SELECT policy, inforce_yy * 12 + inforce_mm - 1 AS m,
    list(DISTINCT vehicle_no || '_' || driver_no) AS items FROM fx_panel GROUP BY 1, 2),
c AS (SELECT a.policy, a.m, b.m IS NOT NULL AS has_previous,
    CASE WHEN b.m IS NULL THEN [] ELSE list_filter(a.items, lambda x: NOT list_contains(b.items, x)) END AS plus,
    CASE WHEN b.m IS NULL THEN [] ELSE list_filter(b.items, lambda x: NOT list_contains(a.items, x)) END AS minus
  FROM s a LEFT JOIN s b ON a.policy = b.policy AND b.m = a.m - 1)
"""
CAL_KEYS = "policy, CAST(m // 12 AS INT) AS inforce_yy, CAST(m % 12 + 1 AS INT) AS inforce_mm"


@query("chg_assignment_set_calendar", CALENDAR + f"""
SELECT {CAL_KEYS}, has_previous, len(plus) AS added, len(minus) AS removed,
  len(plus) + len(minus) > 0 AS major_change FROM c""")
def _(t):
    return ch.policy_month_changes(t.panel, "calendar")


@query("set_added_removed", CALENDAR + f"""
SELECT {CAL_KEYS}, 'added' AS change, 'V' || replace(unnest(plus), '_', '-D') AS assignment FROM c
UNION ALL
SELECT {CAL_KEYS}, 'removed', 'V' || replace(unnest(minus), '_', '-D') FROM c""")
def _(t):
    return ch.assignment_moves(t.panel)


@query("chg_context", CALENDAR + f""",
moves AS (SELECT policy, m, 'added' AS change, 'V' || replace(unnest(plus), '_', '-D') AS assignment FROM c
  UNION ALL SELECT policy, m, 'removed', 'V' || replace(unnest(minus), '_', '-D') FROM c),
f AS (SELECT policy, inforce_yy, inforce_mm, inforce_yy * 12 + inforce_mm - 1 AS m FROM ov_flags
  WHERE major_change)
SELECT f.policy, f.inforce_yy, f.inforce_mm,
  CASE WHEN NOT c.has_previous THEN 'no_previous_month' ELSE coalesce(moves.change, 'none') END AS change,
  moves.assignment
FROM f JOIN c ON f.policy = c.policy AND f.m = c.m
LEFT JOIN moves ON f.policy = moves.policy AND f.m = moves.m""")
def _(t):
    return ch.change_context(t.panel)


@query("chg_detail_month", """
WITH s AS (SELECT policy, inforce_yy, inforce_mm,
    list_sort(list(DISTINCT {'a': vehicle_no, 'b': vehicle_vin, 'c': vehicle_type, 'd': model_year})) AS v,
    list_sort(list(DISTINCT {'a': driver_no, 'b': driver_license_no, 'c': driver_name, 'd': driver_type})) AS d
  FROM fx_panel GROUP BY policy, inforce_yy, inforce_mm),
l AS (SELECT *, lag(v) OVER w AS pv, lag(d) OVER w AS pd,
    lag(inforce_yy * 100 + inforce_mm) OVER w AS pp FROM s
  WINDOW w AS (PARTITION BY policy ORDER BY inforce_yy, inforce_mm)),
a AS (SELECT policy, inforce_yy * 100 + inforce_mm AS p, driver_no, max(driver_age) AS age
  FROM fx_panel GROUP BY 1, 2, 3),
j AS (SELECT l.policy, l.inforce_yy, l.inforce_mm, bool_or(abs(x.age - y.age) > 1) AS jump FROM l
  JOIN a x ON x.policy = l.policy AND x.p = l.inforce_yy * 100 + l.inforce_mm
  JOIN a y ON y.policy = l.policy AND y.p = l.pp AND y.driver_no = x.driver_no GROUP BY 1, 2, 3)
SELECT l.policy, l.inforce_yy, l.inforce_mm, coalesce(v <> pv, false) AS vehicle_changed,
  coalesce(d <> pd, false) AS driver_changed, coalesce(jump, false) AS age_jump,
  coalesce(v <> pv, false) OR coalesce(d <> pd, false) OR coalesce(jump, false) AS major_change
FROM l LEFT JOIN j USING (policy, inforce_yy, inforce_mm)""")
def _(t):
    return ch.detailed_changes(t.panel)


ADJACENT = """
WITH o AS (SELECT *, row_number() OVER w AS rn, lag(vehicle_no) OVER w AS p1,
    lag(vehicle_vin) OVER w AS p2, lag(vehicle_type) OVER w AS p3, lag(model_year) OVER w AS p4,
    lag(driver_no) OVER w AS p5, lag(driver_license_no) OVER w AS p6, lag(driver_name) OVER w AS p7,
    lag(driver_type) OVER w AS p8, lag(driver_age) OVER w AS p9 FROM fx_panel
  WINDOW w AS (PARTITION BY policy ORDER BY inforce_yy, inforce_mm, vehicle_no, driver_no,
    vehicle_vin, vehicle_type, model_year, driver_license_no, driver_name, driver_type, driver_age))
SELECT policy, inforce_yy, inforce_mm, bool_or(rn > 1 AND (rn = 2 OR vehicle_no <> p1
  OR vehicle_vin <> p2 OR vehicle_type <> p3 OR model_year <> p4 OR driver_no <> p5
  OR driver_license_no <> p6 OR driver_name <> p7 OR driver_type <> p8
  OR abs(driver_age - p9) > 1)) AS major_change
FROM o GROUP BY policy, inforce_yy, inforce_mm"""
for _name in ("chg_adjacent_detail", "win_adjacent_row"):
    query(_name, ADJACENT)(lambda t: ch.adjacent_changes(t.panel))


@query("agg_change_summary", """
WITH p AS (SELECT policy, count(*) AS n, count(*) FILTER (WHERE major_change) AS c
  FROM ov_flagged GROUP BY policy)
SELECT CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(c) AS BIGINT) AS records_with_changes,
  CAST(sum(c) AS DOUBLE) / sum(n) * 100 AS change_percentage, count(*) AS total_policies,
  count(*) FILTER (WHERE c > 0) AS policies_with_changes,
  count(*) FILTER (WHERE c > 0) / count(*) * 100 AS policy_change_rate FROM p""")
def _(t):
    return ch.change_summary(ch.flagged_policy_months(t.panel))


COUNTS = """count(*) AS total_records, count(*) FILTER (WHERE major_change) AS change_count,
  count(*) FILTER (WHERE major_change) / count(*) * 100 AS change_rate"""


@query("agg_change_by_year", f"SELECT inforce_yy, {COUNTS} FROM ov_flagged GROUP BY inforce_yy")
def _(t):
    return ch.change_counts(ch.flagged_policy_months(t.panel), ("inforce_yy",))


@query("agg_change_by_month",
       f"SELECT inforce_yy, inforce_mm, {COUNTS} FROM ov_flagged GROUP BY inforce_yy, inforce_mm")
def _(t):
    return ch.change_counts(ch.flagged_policy_months(t.panel), ("inforce_yy", "inforce_mm"))


@query("agg_change_rollup", f"""
SELECT inforce_yy, inforce_mm, {COUNTS} FROM ov_flagged GROUP BY ROLLUP (inforce_yy, inforce_mm)""")
def _(t):
    return ch.change_rollup(ch.flagged_policy_months(t.panel))


@query("agg_change_by_policy", """
SELECT policy, count(*) AS total_records, count(*) FILTER (WHERE major_change) AS change_count
FROM ov_flagged GROUP BY policy""")
def _(t):
    return ch.changes_by_policy(ch.flagged_policy_months(t.panel))


TIMELINE = """SELECT policy, inforce_yy, inforce_mm, count(*) OVER (PARTITION BY policy)
  AS change_months FROM ov_flags WHERE major_change"""
@query("chg_timeline", TIMELINE)
def _(t):
    return ch.change_timeline(_changed(t)).orderBy("policy", "inforce_yy", "inforce_mm")


@query("sort_policy_timeline", """
SELECT policy, inforce_yy, inforce_mm, vehicle_no, driver_no, row_number() OVER (PARTITION BY policy
  ORDER BY inforce_yy, inforce_mm, vehicle_no, driver_no) - 1 AS position FROM fx_panel""")
def _(t):
    return lookups.policy_timeline(t.panel)


@query("chg_records", """
SELECT inforce_yy, inforce_mm, policy, vehicle_no, driver_no, driver_name, assignment_type
FROM ov_flagged WHERE major_change""")
def _(t):
    return ch.change_records(ch.flag_panel(t.panel))


@query("win_first_change", """
SELECT policy, min(inforce_yy * 100 + inforce_mm) AS first_change_period FROM ov_flags
WHERE major_change GROUP BY policy""")
def _(t):
    return ch.first_change(_changed(t))


@query("win_next_change", """
SELECT policy, inforce_yy, inforce_mm, lead(inforce_yy * 100 + inforce_mm)
  OVER (PARTITION BY policy ORDER BY inforce_yy, inforce_mm) AS next_change_period
FROM ov_flags WHERE major_change""")
def _(t):
    return ch.next_change(_changed(t))


@query("win_next_change_after", """
SELECT policy, min(inforce_yy * 100 + inforce_mm) AS next_change_period FROM ov_flags
WHERE major_change AND inforce_yy * 100 + inforce_mm > 199806 GROUP BY policy""")
def _(t):
    return ch.next_change_after(_changed(t), 199806)


FIRSTS = """
WITH f AS (SELECT policy, min(inforce_yy * 100 + inforce_mm) AS p FROM ov_flags
  WHERE major_change GROUP BY policy)
"""


@query("win_next_changed_policy", FIRSTS + """
SELECT policy, lead(policy) OVER (ORDER BY policy) AS next_policy,
  lead(p) OVER (ORDER BY policy) AS next_first_change_period FROM f""")
def _(t):
    return ch.next_changed_policy(_changed(t))


@query("win_next_changed_policy_after", FIRSTS + """
SELECT policy, p AS first_change_period FROM f
WHERE policy > (CASE WHEN EXISTS (SELECT 1 FROM f WHERE policy = '00000042') THEN '00000042' ELSE '' END)
ORDER BY policy LIMIT 1""")
def _(t):
    return ch.next_changed_policy_after(_changed(t), "00000042")


# --- filters and sets ----------------------------------------------------------------------

ROWS = "policy, inforce_yy, inforce_mm, vehicle_vin, driver_license_no, premium_paid"


def _rows(df):
    return df.select(*[c.strip() for c in ROWS.split(",")])


@query("filter_period_range", f"""
SELECT {ROWS} FROM fx_panel WHERE inforce_yy * 100 + inforce_mm BETWEEN 199611 AND 199802""")
def _(t):
    return _rows(lookups.in_period_range(t.panel, 199611, 199802))


@query("filter_policy_month", f"""
SELECT {ROWS} FROM fx_panel WHERE policy = (SELECT min(policy) FROM fx_panel
  WHERE inforce_yy = 1998 AND inforce_mm = 5) AND inforce_yy = 1998 AND inforce_mm = 5""")
def _(t):
    # The viewer opens on the first policy of the month.
    first = t.panel.where("inforce_yy = 1998 AND inforce_mm = 5").agg(F.min("policy")).first()[0]
    return _rows(lookups.policy_month(t.panel, first, 1998, 5))


@query("filter_month_pair", f"""
SELECT {ROWS} FROM fx_panel WHERE inforce_yy * 100 + inforce_mm IN (199712, 199801)""")
def _(t):
    return _rows(lookups.month_pair(t.panel, 1998, 1))


@query("filter_events_month", """
SELECT change_type, date, family_id, vehicle_no, reason FROM fx_changes_log
WHERE strftime(date, '%Y-%m') = '2001-01'""")
def _(t):
    from monthmark.operators.events import events_in_month
    return events_in_month(t.changes_log, 2001, 1)


@query("pred_exposure_anomaly", f"""
WITH d AS (SELECT policy, inforce_yy, inforce_mm, count(*) AS drivers FROM
  (SELECT DISTINCT policy, inforce_yy, inforce_mm, driver_no, driver_name, driver_age, driver_type
   FROM fx_panel) x GROUP BY 1, 2, 3)
SELECT {ROWS}, exposure_factor, drivers FROM fx_panel JOIN d USING (policy, inforce_yy, inforce_mm)
WHERE assignment_type = 'primary' AND ((exposure_factor <> 1.0 AND drivers = 1)
  OR (exposure_factor = 1.0 AND drivers > 1))""")
def _(t):
    out = lookups.exposure_anomalies(t.panel)
    return out.select(*[c.strip() for c in ROWS.split(",")], "exposure_factor", "drivers")


@query("proj_period_split", """
SELECT policy, vehicle_vin, inforce_yy * 100 + inforce_mm AS period, inforce_yy AS period_year,
  inforce_mm AS period_month FROM fx_panel""")
def _(t):
    return lookups.with_period_parts(t.panel).select("policy", "vehicle_vin", "period",
                                                     "period_year", "period_month")


@query("proj_assignment_key", """
SELECT policy, inforce_yy, inforce_mm, vehicle_no || '_' || driver_no AS assignment_id
FROM fx_panel""")
def _(t):
    from monthmark.functions.columns import assignment_key
    return t.panel.select("policy", "inforce_yy", "inforce_mm",
                          assignment_key().alias("assignment_id"))


@query("proj_month_end", """
SELECT policy, inforce_yy, inforce_mm, last_day(make_date(inforce_yy, inforce_mm, 1)) AS month_end
FROM fx_panel""")
def _(t):
    from monthmark.functions.columns import month_end
    return t.panel.select("policy", "inforce_yy", "inforce_mm", month_end().alias("month_end"))


@query("set_distinct", """
SELECT 'driver' AS kind, policy, inforce_yy, inforce_mm, driver_no AS no, driver_name AS name FROM
  (SELECT DISTINCT policy, inforce_yy, inforce_mm, driver_no, driver_name, driver_age FROM fx_panel) d
UNION ALL
SELECT 'vehicle', policy, inforce_yy, inforce_mm, vehicle_no, vehicle_type FROM
  (SELECT DISTINCT policy, inforce_yy, inforce_mm, vehicle_no, vehicle_type, model_year FROM fx_panel) v""")
def _(t):
    d = lookups.month_drivers(t.panel).select(
        F.lit("driver").alias("kind"), *ch.KEYS, F.col("driver_no").alias("no"),
        F.col("driver_name").alias("name"))
    v = lookups.month_vehicles(t.panel).select(
        F.lit("vehicle").alias("kind"), *ch.KEYS, F.col("vehicle_no").alias("no"),
        F.col("vehicle_type").alias("name"))
    return d.unionByName(v)


@query("set_distinct_policies", "SELECT DISTINCT policy FROM fx_panel")
def _(t):
    return lookups.distinct_policies(t.panel)


@query("set_distinct_periods", "SELECT DISTINCT inforce_yy, inforce_mm FROM fx_panel")
def _(t):
    return lookups.distinct_periods(t.panel)


@query("set_union_keys", """
SELECT policy_no AS policy FROM fx_policies UNION SELECT policy FROM fx_panel""")
def _(t):
    return lookups.union_keys(t.policies, t.panel, "policy_no", "policy")


@query("set_union_log", """
SELECT change_type, date, family_id, vehicle_no, reason, CAST(NULL AS VARCHAR) AS policy_no,
  CAST(NULL AS DATE) AS old_expiry_date, CAST(NULL AS DATE) AS new_expiry_date FROM fx_changes_log
UNION ALL
SELECT 'policy_renewal', CAST(date_trunc('month', d) AS DATE), family_id, NULL, 'annual_renewal',
  policy_no, d, d + 365 FROM (
  SELECT family_id, policy_no, current_expiry_date + 365 * CAST(k AS INT) AS d
  FROM fx_policies, range(0, 10) r(k) WHERE status = 'active') x WHERE d <= DATE '2001-08-31'""")
def _(t):
    from monthmark.operators.events import renewals, union_logs
    return union_logs(t.changes_log, renewals(t.policies, t.params, "in_month"))


@query("semi_first_in_active", """
WITH f AS (SELECT policy, min(inforce_yy) * 100 + min(inforce_mm) AS first_period FROM fx_panel
  GROUP BY policy)
SELECT policy, first_period FROM f WHERE EXISTS (SELECT 1 FROM fx_panel p
  WHERE p.policy = f.policy AND p.inforce_yy * 100 + p.inforce_mm = f.first_period)""")
def _(t):
    return lookups.first_in_active(t.panel)
