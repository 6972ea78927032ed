"""Aggregations, top-k tables, lifecycle tables and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthmark.functions.columns import period
from monthmark.operators import aggregates as agg
from monthmark.operators import lifecycle, quality
from monthmark.operators.changes import changed_months
from monthmark.plans.catalog.fragments import (described, dev, money_mean, money_sum,
                                               rounded_ratio)
from monthmark.plans.registry import query

PAID_MEAN = money_mean("premium_paid")
PAID_SUM = money_sum("premium_paid")
MONTHS = "GROUP BY inforce_yy, inforce_mm"
DISTINCTS = ("count(DISTINCT policy) AS unique_policies, "
             "count(DISTINCT vehicle_no) AS unique_vehicles, "
             "count(DISTINCT driver_no) AS unique_drivers")
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _rounded_long(df):
    """Deviations of long tables to four decimals (their last digits depend on merge order)."""
    return df.withColumn("value", F.when(
        F.col("metric").isin("stddev", "mean") & ~F.col("column_name").isin("driver_age"),
        F.round("value", 4)).otherwise(
            F.when(F.col("metric") == "stddev", F.round("value", 4)).otherwise(F.col("value"))))


# --- statistics -----------------------------------------------------------------------

@query("agg_basic_stats", f"""
SELECT {money_mean('premium_rate')} AS premium_rate_mean, min(premium_rate) AS premium_rate_min,
  max(premium_rate) AS premium_rate_max, {dev('premium_rate')} AS premium_rate_stddev,
  {PAID_MEAN} AS premium_paid_mean, min(premium_paid) AS premium_paid_min,
  max(premium_paid) AS premium_paid_max, {dev('premium_paid')} AS premium_paid_stddev,
  avg(driver_age) AS driver_age_mean, min(driver_age) AS driver_age_min,
  max(driver_age) AS driver_age_max, {dev('driver_age')} AS driver_age_stddev
FROM fx_panel""")
def _(t):
    cols = ["premium_rate", "premium_paid", "driver_age"]
    out = agg.basic_stats(t.panel, cols, money=("premium_rate", "premium_paid"))
    return agg.round_columns(out, [f"{c}_stddev" for c in cols])


@query("agg_categorical_summary", """
SELECT 'vehicle_type' AS column_name, vehicle_type AS value, count(*) AS count FROM fx_panel GROUP BY 2
UNION ALL SELECT 'driver_type', driver_type, count(*) FROM fx_panel GROUP BY 2
UNION ALL SELECT 'assignment_type', assignment_type, count(*) FROM fx_panel GROUP BY 2""")
def _(t):
    return agg.categorical_summary(t.panel, ["vehicle_type", "driver_type", "assignment_type"])


PREMIUM_COLUMNS = f"""count(*) AS record_count, count(DISTINCT policy) AS unique_policies,
  {PAID_MEAN} AS avg_premium, min(premium_paid) AS min_premium, max(premium_paid) AS max_premium,
  {dev('premium_paid')} AS premium_stddev, {PAID_SUM} AS total_premium"""
AGE_COLUMNS = f"""count(*) AS record_count, avg(driver_age) AS avg_age, min(driver_age) AS min_age,
  max(driver_age) AS max_age, {dev('driver_age')} AS age_stddev"""


@query("agg_premium_analysis", f"""
SELECT vehicle_type, driver_type, {PREMIUM_COLUMNS} FROM fx_panel GROUP BY vehicle_type, driver_type""")
def _(t):
    out = agg.premium_analysis(t.panel, by=("vehicle_type", "driver_type"))
    return agg.round_columns(out, ["premium_stddev"])


@query("agg_premium_analysis_total", f"SELECT {PREMIUM_COLUMNS} FROM fx_panel")
def _(t):
    return agg.round_columns(agg.premium_analysis(t.panel), ["premium_stddev"])


@query("agg_age_analysis", f"SELECT driver_type, {AGE_COLUMNS} FROM fx_panel GROUP BY driver_type")
def _(t):
    return agg.round_columns(agg.age_analysis(t.panel, by=("driver_type",)), ["age_stddev"])


@query("agg_age_analysis_total", f"SELECT {AGE_COLUMNS} FROM fx_panel")
def _(t):
    return agg.round_columns(agg.age_analysis(t.panel), ["age_stddev"])


for _name, _by in (("agg_vehicle_type", "vehicle_type"), ("agg_model_year", "model_year")):
    query(_name, f"""
SELECT {_by}, count(*) AS count, count(DISTINCT policy) AS unique_policies,
  {PAID_MEAN} AS avg_premium FROM fx_panel GROUP BY {_by}""")(
        lambda t, by=_by: agg.vehicle_analysis(t.panel, by))


@query("agg_vehicle_age", f"""
SELECT 2024 - model_year AS vehicle_age, count(*) AS count,
  count(DISTINCT policy) AS unique_policies, {PAID_MEAN} AS avg_premium
FROM fx_panel GROUP BY 1""")
def _(t):
    aged = agg.with_vehicle_age(t.panel, t.params.as_of_year)
    return agg.vehicle_analysis(aged, "vehicle_age")


@query("proj_vehicle_age", """
SELECT policy, inforce_yy, inforce_mm, vehicle_vin, 2024 - model_year AS vehicle_age FROM fx_panel""")
def _(t):
    return agg.with_vehicle_age(t.panel, t.params.as_of_year).select(
        "policy", "inforce_yy", "inforce_mm", "vehicle_vin", "vehicle_age")


TEMPORAL = f"count(*) AS record_count, {DISTINCTS}, {PAID_MEAN} AS avg_premium, {PAID_SUM} AS total_premium"
for _name in ("agg_temporal", "agg_monthly_profile"):
    query(_name, f"SELECT inforce_yy, inforce_mm, {TEMPORAL} FROM fx_panel {MONTHS}")(
        lambda t: agg.temporal_report(t.panel))


@query("agg_temporal_composite", f"""
SELECT inforce_yy, inforce_mm, count(*) AS record_count, count(DISTINCT policy) AS unique_policies,
  count(DISTINCT policy || '/' || vehicle_no) AS unique_vehicles,
  count(DISTINCT policy || '/' || driver_no) AS unique_drivers,
  {PAID_MEAN} AS avg_premium, {PAID_SUM} AS total_premium FROM fx_panel {MONTHS}""")
def _(t):
    return agg.temporal_report(t.panel, scope="composite")


@query("agg_yearly_trends", f"SELECT inforce_yy, {TEMPORAL} FROM fx_panel GROUP BY inforce_yy")
def _(t):
    return agg.temporal_report(t.panel, ("inforce_yy",))


@query("agg_monthly_inforce", f"""
SELECT inforce_yy, inforce_mm, count(DISTINCT policy) AS inforce_policies,
  {PAID_MEAN} AS avg_premium, avg(driver_age) AS avg_driver_age FROM fx_panel {MONTHS}""")
def _(t):
    return agg.monthly_inforce(t.panel)


@query("agg_monthly_trends", f"""
SELECT inforce_yy, inforce_mm, count(*) AS record_count,
  count(DISTINCT policy) AS unique_policies, {PAID_MEAN} AS avg_premium FROM fx_panel {MONTHS}""")
def _(t):
    return agg.monthly_trends(t.panel)


@query("agg_vehicle_type_profile", f"""
SELECT vehicle_type, count(*) AS record_count, count(DISTINCT policy) AS unique_policies,
  {PAID_MEAN} AS avg_premium FROM fx_panel GROUP BY vehicle_type""")
def _(t):
    return agg.type_profile(t.panel, "vehicle_type")


@query("agg_driver_type_profile", f"""
SELECT driver_type, count(*) AS record_count, count(DISTINCT policy) AS unique_policies,
  {PAID_MEAN} AS avg_premium, avg(driver_age) AS avg_age FROM fx_panel GROUP BY driver_type""")
def _(t):
    return agg.type_profile(t.panel, "driver_type", with_age=True)


@query("agg_premium_by_driver_type",
       f"SELECT driver_type, {PAID_MEAN} AS avg_premium FROM fx_panel GROUP BY driver_type")
def _(t):
    return agg.premium_by_driver_type(t.panel)


@query("agg_type_counts", "SELECT driver_type, count(*) AS count FROM fx_panel GROUP BY driver_type")
def _(t):
    return agg.value_counts(t.panel, "driver_type")


@query("topk_types", """
SELECT vehicle_type, count(*) AS count FROM fx_panel GROUP BY vehicle_type
ORDER BY count DESC, vehicle_type LIMIT 5""")
def _(t):
    return agg.top_types(t.panel)


@query("agg_model_year_mode", """
WITH c AS (SELECT model_year, count(*) AS n FROM fx_panel GROUP BY model_year)
SELECT min(model_year) AS min_year, max(model_year) AS max_year,
  (SELECT model_year FROM c ORDER BY n DESC, model_year LIMIT 1) AS most_common_year,
  max(n) AS most_common_count FROM c""")
def _(t):
    return agg.model_year_mode(t.panel)


for _name, _key, _alias in (("agg_vehicles_per_policy", "vehicle_no", "vehicles"),
                            ("agg_drivers_per_policy", "driver_no", "drivers")):
    query(_name, f"""
SELECT avg(n) AS mean_{_alias}, max(n) AS max_{_alias} FROM
  (SELECT policy, count(DISTINCT {_key}) AS n FROM fx_panel GROUP BY policy) x""")(
        lambda t, key=_key, alias=_alias: agg.per_policy_count(t.panel, key, alias))


@query("agg_year_minmax", """
SELECT min(inforce_yy) AS min_value, max(inforce_yy) AS max_value, min(n) AS min_count,
  max(n) AS max_count FROM (SELECT inforce_yy, count(*) AS n FROM fx_panel GROUP BY inforce_yy) x""")
def _(t):
    return agg.rows_span(t.panel, "inforce_yy")


@query("agg_month_minmax", """
SELECT min(n) AS min_count, max(n) AS max_count FROM
  (SELECT inforce_mm, count(*) AS n FROM fx_panel GROUP BY inforce_mm) x""")
def _(t):
    return agg.rows_span(t.panel, "inforce_mm", with_span=False)


for _name in ("agg_expiry_top10", "topk_expiry"):
    _k = 10 if _name == "agg_expiry_top10" else 3
    query(_name, f"""
SELECT policy_expiry_date, count(*) AS count FROM fx_panel GROUP BY policy_expiry_date
ORDER BY count DESC, policy_expiry_date LIMIT {_k}""")(
        lambda t, k=_k: agg.top_expiry_dates(t.panel, k))


def _median(column: str) -> str:
    return (f"\nUNION ALL SELECT '{column}', 'median', "
            f"CAST(quantile_cont({column}, 0.5) AS DOUBLE) FROM fx_panel")


for _name, _column, _money in (("agg_tenure_stats", "client_tenure_days", False),
                               ("agg_age_stats", "driver_age", False),
                               ("agg_premium_stats", "premium_paid", True)):
    query(_name, described("fx_panel", _column, PAID_MEAN if _money else None)
          + _median(_column))(
        lambda t, c=_column, m=_money: agg.stats_with_median(t.panel, c, m).withColumn(
            "value", F.when(F.col("metric") == "stddev", F.round("value", 4))
            .otherwise(F.col("value"))))


@query("agg_median", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median FROM fx_panel"
    for c in ("premium_paid", "premium_rate", "client_tenure_days", "driver_age")))
def _(t):
    from monthmark.functions.ranking import exact_median
    return exact_median(t.panel, ["premium_paid", "premium_rate", "client_tenure_days",
                                  "driver_age"])


@query("agg_distinct_cardinality",
       f"SELECT {DISTINCTS}, count(DISTINCT driver_name) AS unique_driver_names FROM fx_panel")
def _(t):
    return agg.distinct_cardinality(t.panel)


@query("agg_distinct_cardinality_composite", """
SELECT count(DISTINCT policy) AS unique_policies,
  count(DISTINCT policy || '/' || vehicle_no) AS unique_vehicles,
  count(DISTINCT policy || '/' || driver_no) AS unique_drivers,
  count(DISTINCT driver_name) AS unique_driver_names FROM fx_panel""")
def _(t):
    return agg.distinct_cardinality(t.panel, scope="composite")


@query("agg_date_range", """
SELECT min(inforce_yy * 100 + inforce_mm) AS first_period,
  max(inforce_yy * 100 + inforce_mm) AS last_period FROM fx_panel""")
def _(t):
    return agg.date_range(t.panel)


@query("agg_date_stats", """
SELECT min(inforce_yy) AS min_year, max(inforce_yy) AS max_year, min(inforce_mm) AS min_month,
  max(inforce_mm) AS max_month FROM fx_panel""")
def _(t):
    return agg.date_stats(t.panel)


def _text_rows(column: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{m}' AS metric, CAST(NULL AS DOUBLE) AS value, "
        f"CAST({m}({column}) AS VARCHAR) AS text FROM fx_panel" for m in ("count", "min", "max"))


@query("agg_describe", "\nUNION ALL ".join(
    [f"SELECT column_name, metric, value, CAST(NULL AS VARCHAR) AS text FROM ("
     + described("fx_panel", c, PAID_MEAN if c == "premium_paid" else None) + ") x"
     for c in ("inforce_yy", "inforce_mm", "premium_paid", "driver_age")]
    + [_text_rows(c) for c in ("policy", "vehicle_type", "driver_type")]))
def _(t):
    return agg.data_summary(t.panel).withColumn(
        "value", F.when(F.col("metric") == "stddev", F.round("value", 4)).otherwise(F.col("value")))


TOPS = """
SELECT column_name, value, count, rank, unique_count FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INT) AS rank,
    count(*) OVER (PARTITION BY column_name) AS unique_count FROM (
    SELECT 'vehicle_type' AS column_name, vehicle_type AS value, count(*) AS count FROM fx_panel GROUP BY 2
    UNION ALL SELECT 'driver_type', driver_type, count(*) FROM fx_panel GROUP BY 2
    UNION ALL SELECT 'driver_name', driver_name, count(*) FROM fx_panel GROUP BY 2
    UNION ALL SELECT 'assignment_type', assignment_type, count(*) FROM fx_panel GROUP BY 2) c) r
WHERE rank <= 10"""
for _name in ("agg_top_values", "topk_values"):
    query(_name, TOPS)(lambda t: agg.top_values(
        t.panel, ["vehicle_type", "driver_type", "driver_name", "assignment_type"]))


@query("agg_policy_metrics", """
WITH m AS (SELECT policy, count(*) AS record_count, count(DISTINCT vehicle_no) AS vehicle_count,
  count(DISTINCT driver_no) AS driver_count, """ + PAID_MEAN + """ AS avg_premium
  FROM fx_panel GROUP BY policy)
""" + "\nUNION ALL ".join(described("m", c, f"round(avg({c}), 4)") for c in
                          ("record_count", "vehicle_count", "driver_count", "avg_premium")))
def _(t):
    return _rounded_long(agg.policy_metrics(t.panel))


VEHICLE_METRICS = """
WITH m AS (SELECT {key} AS vehicle, count(*) AS record_count,
  count(DISTINCT driver_no) AS driver_count, """ + PAID_MEAN + """ AS avg_premium
  FROM fx_panel GROUP BY 1)
""" + "\nUNION ALL ".join(described("m", c, f"round(avg({c}), 4)") for c in
                          ("record_count", "driver_count", "avg_premium"))
for _name, _scope, _key in (("agg_vehicle_metrics", "raw", "vehicle_no"),
                            ("agg_vehicle_metrics_composite", "composite",
                             "policy || '/' || vehicle_no")):
    query(_name, VEHICLE_METRICS.replace("{key}", _key))(
        lambda t, s=_scope: _rounded_long(agg.vehicle_metrics(t.panel, s)))


# --- distributions over time ------------------------------------------------------------

SHARE = """
SELECT inforce_yy, inforce_mm, vehicle_type, count, total_vehicles,
  count / total_vehicles * 100 AS vehicle_type_pct FROM (
  SELECT inforce_yy, inforce_mm, vehicle_type, count(*) AS count,
    CAST(sum(count(*)) OVER (PARTITION BY inforce_yy, inforce_mm) AS BIGINT) AS total_vehicles
  FROM fx_panel GROUP BY inforce_yy, inforce_mm, vehicle_type) x"""
for _name in ("agg_type_share", "win_share"):
    query(_name, SHARE)(lambda t: agg.type_share(t.panel))

PIVOT = "SELECT inforce_yy, inforce_mm, " + ", ".join(
    f"count(*) FILTER (WHERE vehicle_type = '{v}') / count(vehicle_type) * 100 "
    f"AS \"vehicle_type_{v}_pct\"" for v in TYPES) + f" FROM fx_panel {MONTHS}"


@query("agg_type_share_pivot", PIVOT)
def _(t):
    return agg.type_share_pivot(t.panel, t.panel_types)


def _first(column: str) -> str:
    return f"arg_min({column}, (vehicle_no, driver_no, {column}))"


@query("agg_type_share_pivot_policies", f"""
WITH f AS (SELECT policy, inforce_yy, inforce_mm, {_first('vehicle_type')} AS vehicle_type
  FROM fx_panel GROUP BY policy, inforce_yy, inforce_mm)
SELECT inforce_yy, inforce_mm, """ + ", ".join(
    rounded_ratio(f"100*(count(*) FILTER (WHERE vehicle_type = '{v}'))", "count(vehicle_type)", 1)
    + f' AS "vehicle_type_{v}_pct"' for v in TYPES) + f" FROM f {MONTHS}")
def _(t):
    return agg.type_share_pivot(t.panel, t.panel_types, first_row_only=True, scale=1)


FIRST_FLAGGED = f"""
WITH f AS (SELECT policy, inforce_yy, inforce_mm, {_first('premium_paid')} AS premium_paid,
  {_first('driver_age')} AS driver_age, bool_or(major_change) AS major_change
  FROM ov_flagged GROUP BY policy, inforce_yy, inforce_mm)
"""


@query("win_first_row", f"""
SELECT policy, inforce_yy, inforce_mm, {_first('vehicle_type')} AS vehicle_type,
  {_first('premium_paid')} AS premium_paid, {_first('driver_age')} AS driver_age
FROM fx_panel GROUP BY policy, inforce_yy, inforce_mm""")
def _(t):
    return agg.first_rows(t.panel, ["vehicle_type", "premium_paid", "driver_age"])


@query("agg_monthly_unique_policy", FIRST_FLAGGED + f"""
SELECT inforce_yy, inforce_mm, count(*) AS inforce_count, {PAID_MEAN} AS avg_premium,
  avg(driver_age) AS avg_driver_age, count(*) FILTER (WHERE major_change) AS major_change_count,
  count(*) FILTER (WHERE major_change) / count(*) AS major_change_rate FROM f {MONTHS}""")
def _(t):
    return agg.monthly_unique_policy(t.panel, changed_months(t.panel))


def _split(cond: str, suffix: str) -> str:
    paid = money_mean(f"CASE WHEN {cond} THEN premium_paid END").replace(
        "/count(CASE", "/nullif(count(CASE").replace("END)/100", "END),0)/100")
    return (f"{paid} AS avg_premium_{suffix}, "
            f"avg(CASE WHEN {cond} THEN driver_age END) AS avg_driver_age_{suffix}")


@query("agg_monthly_change_split", FIRST_FLAGGED + f"""
SELECT inforce_yy, inforce_mm, {_split('major_change', 'with_changes')},
  {_split('NOT major_change', 'without_changes')} FROM f {MONTHS}""")
def _(t):
    return agg.monthly_change_split(t.panel, changed_months(t.panel))


NEW = """
WITH pm AS (SELECT DISTINCT policy, inforce_yy * 100 + inforce_mm AS period FROM fx_panel),
fp AS (SELECT policy, min(period) AS period FROM pm GROUP BY policy),
nn AS (SELECT period, count(*) AS new_policies FROM fp GROUP BY period),
inf AS (SELECT period, count(*) AS inforce_count FROM pm GROUP BY period),
nr AS (SELECT inf.period, inforce_count, coalesce(new_policies, 0) AS new_policies,
  inforce_count - coalesce(new_policies, 0) AS renewed_policies
  FROM inf LEFT JOIN nn ON inf.period = nn.period)
"""


@query("agg_new_renewed", NEW + "SELECT * FROM nr")
def _(t):
    return lifecycle.new_renewed(t.panel)


for _name in ("agg_cumulative", "win_running_total"):
    query(_name, NEW + """SELECT period, CAST(sum(new_policies) OVER (ORDER BY period) AS BIGINT)
  AS cumulative_policy_count FROM nr""")(lambda t: lifecycle.cumulative_policies(t.panel))

RETENTION = """
WITH u AS (SELECT inforce_yy, inforce_mm, count(DISTINCT policy) AS unique_policies
  FROM fx_panel GROUP BY inforce_yy, inforce_mm)
SELECT inforce_yy AS period_year, inforce_mm AS period_month, unique_policies,
  coalesce(unique_policies / lag(unique_policies) OVER (ORDER BY inforce_yy, inforce_mm), 1.0)
  AS retention_rate FROM u"""
for _name in ("agg_retention", "win_lag_count"):
    query(_name, RETENTION)(lambda t: lifecycle.retention(t.panel))


@query("agg_retention_true", """
WITH pm AS (SELECT DISTINCT policy, inforce_yy * 12 + inforce_mm - 1 AS m FROM fx_panel),
j AS (SELECT a.m, count(*) AS unique_policies, count(b.policy) AS retained_policies
  FROM pm a LEFT JOIN pm b ON a.policy = b.policy AND b.m = a.m - 1 GROUP BY a.m)
SELECT CAST(m // 12 AS INT) AS period_year, CAST(m % 12 + 1 AS INT) AS period_month,
  unique_policies, coalesce((SELECT k.unique_policies FROM j k WHERE k.m = j.m - 1), 0)
  AS previous_policies, retained_policies,
  retained_policies / nullif((SELECT k.unique_policies FROM j k WHERE k.m = j.m - 1), 0)
  AS retention_rate FROM j""")
def _(t):
    return lifecycle.retention_true(t.panel)


@query("agg_cohort", """
SELECT CAST(year(d) * 100 + month(d) AS INT) AS cohort_period, count(*) AS cohort_size
FROM (SELECT policy, min(policy_expiry_date) AS d FROM fx_panel GROUP BY policy) x GROUP BY 1""")
def _(t):
    return lifecycle.cohorts(t.panel)


@query("agg_premium_levels", """
SELECT policy, count(DISTINCT premium_paid) AS distinct_premiums,
  count(DISTINCT premium_paid) = 1 AS is_static FROM fx_panel GROUP BY policy""")
def _(t):
    return agg.premium_levels(t.panel)


@query("agg_before_after", """
WITH s AS (SELECT policy, inforce_yy * 100 + inforce_mm < 199805 AS b, vehicle_type AS v,
    CAST(premium_rate AS VARCHAR) AS r FROM fx_panel WHERE inforce_yy BETWEEN 1995 AND 2001),
g AS (SELECT policy,
    coalesce(list_sort(list(DISTINCT v) FILTER (WHERE b)), []) AS tb,
    coalesce(list_sort(list(DISTINCT v) FILTER (WHERE NOT b)), []) AS ta,
    coalesce(list_sort(list(DISTINCT r) FILTER (WHERE b)), []) AS rb,
    coalesce(list_sort(list(DISTINCT r) FILTER (WHERE NOT b)), []) AS ra
  FROM s GROUP BY policy)
SELECT policy, len(tb) AS types_before, len(ta) AS types_after, len(rb) AS rates_before,
  len(ra) AS rates_after, tb <> ta AS type_changed, rb <> ra AS rate_changed FROM g""")
def _(t):
    return agg.before_after(t.panel, 199805)


@query("agg_policy_month_breakdown", f"""
SELECT policy, inforce_yy, inforce_mm, driver_name, vehicle_no, premium_rate, exposure_factor,
  premium_paid, total_premium FROM fx_panel JOIN
  (SELECT policy, inforce_yy, inforce_mm, {PAID_SUM} AS total_premium FROM fx_panel
   GROUP BY policy, inforce_yy, inforce_mm) x USING (policy, inforce_yy, inforce_mm)""")
def _(t):
    return agg.policy_month_breakdown(t.panel)


DISTRIBUTION = f"""
WITH r AS (SELECT policy, inforce_yy, inforce_mm, count(*) AS n,
    sum(CAST(round(premium_paid * 100) AS BIGINT)) AS cents, sum(driver_age) AS ages,
    count(DISTINCT driver_no) AS drivers, count(DISTINCT vehicle_no) AS vehicles,
    bool_or(major_change) AS mc
  FROM ov_flagged GROUP BY policy, inforce_yy, inforce_mm),
fp AS (SELECT policy, min(inforce_yy * 100 + inforce_mm) AS p FROM r GROUP BY policy),
m AS (SELECT inforce_yy AS year, inforce_mm AS month, count(*) AS inforce_count,
    {rounded_ratio('sum(cents)', 'sum(n)', 0)} / 100 AS avg_premium,
    {rounded_ratio('sum(ages)', 'sum(n)', 1)} AS avg_driver_age,
    {rounded_ratio('sum(drivers)', 'count(*)', 2)} AS avg_driver_count,
    {rounded_ratio('sum(vehicles)', 'count(*)', 2)} AS avg_vehicle_count,
    CAST(coalesce(sum(n) FILTER (WHERE mc), 0) AS BIGINT) AS major_change_rows,
    {rounded_ratio('coalesce(sum(n) FILTER (WHERE mc), 0)', 'sum(n)', 3)} AS major_change_row_rate,
    count(*) FILTER (WHERE mc) AS major_change_policies,
    {rounded_ratio('count(*) FILTER (WHERE mc)', 'count(*)', 3)} AS major_change_policy_rate
  FROM r GROUP BY inforce_yy, inforce_mm)
SELECT m.*, (SELECT count(*) FROM fp WHERE p <= year * 100 + month) AS cumulative_policy_count,
  (SELECT count(*) FROM fp WHERE p = year * 100 + month) AS new_policies,
  inforce_count - (SELECT count(*) FROM fp WHERE p = year * 100 + month) AS renewed_policies
FROM m"""


def _as_doubles(df):
    return df.select(*[F.col(f.name).cast("double") if f.dataType.typeName() == "decimal"
                       else F.col(f.name) for f in df.schema])


for _name in ("agg_monthly_distribution", "proj_report_round"):
    query(_name, DISTRIBUTION)(lambda t: _as_doubles(
        lifecycle.monthly_distribution(t.panel, changed_months(t.panel))))


# --- quality ------------------------------------------------------------------------------

RULES = {"negative_premiums": "premium_paid < 0",
         "invalid_ages": "driver_age < 16 OR driver_age > 100",
         "future_model_years": "model_year > 2010", "negative_tenure": "client_tenure_days < 0"}
# The fixture's model years end in 2020, so the rule is run as of 2010.
AS_OF = 2010


@query("agg_nulls", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, "
    f"(count(*) - count({c})) / count(*) * 100 AS null_percentage FROM x"
    for c in ("family_id", "vehicle_no", "vin", "removal_date", "status")).join(
        ["WITH x AS (SELECT family_id, vehicle_no, vin, removal_date, status FROM fx_vehicles)\n",
         ""]))
def _(t):
    return quality.null_counts(t.vehicles, ["family_id", "vehicle_no", "vin", "removal_date",
                                            "status"])


@query("agg_duplicates", """
WITH d AS (SELECT DISTINCT policy, inforce_yy, inforce_mm, vehicle_no, driver_no FROM fx_panel),
c AS (SELECT (SELECT count(*) FROM fx_panel) AS total_records, (SELECT count(*) FROM d) AS k)
SELECT total_records, total_records - k AS duplicate_records,
  (total_records - k) / total_records * 100 AS duplicate_percentage FROM c""")
def _(t):
    return quality.duplicates(t.panel.select("policy", "inforce_yy", "inforce_mm", "vehicle_no",
                                             "driver_no"))


@query("agg_consistency", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {e}) AS {n}" for n, e in RULES.items()) + " FROM fx_panel")
def _(t):
    return quality.consistency(t.panel, AS_OF)


@query("pred_consistency", f"""
SELECT policy, inforce_yy, inforce_mm, vehicle_vin, model_year,
  {', '.join(f'({e}) AS {n}' for n, e in RULES.items())}
FROM fx_panel WHERE {' OR '.join(f'({e})' for e in RULES.values())}""")
def _(t):
    return quality.inconsistent_rows(t.panel, AS_OF).select(
        "policy", "inforce_yy", "inforce_mm", "vehicle_vin", "model_year", *RULES)


def _tidy_sql(section: str, metric: str, expr: str, source: str = "fx_panel") -> str:
    return (f"SELECT '{section}' AS section, '{metric}' AS metric, "
            f"CAST({expr} AS DOUBLE) AS value FROM {source}")


PANEL_COLUMNS = ("inforce_yy inforce_mm policy policy_expiry_date client_tenure_days vehicle_no "
                 "vehicle_vin vehicle_type model_year driver_no driver_license_no driver_name "
                 "driver_type assignment_type exposure_factor driver_age premium_rate "
                 "premium_paid").split()
DUPES = "(SELECT count(*) AS k FROM (SELECT DISTINCT * FROM fx_panel) d) x"
TOTAL = "(SELECT count(*) FROM fx_panel)"
KEYS = ("policy", "vehicle_no", "driver_no", "premium_paid")


def _quality_sql(columns) -> list[str]:
    return ([_tidy_sql("totals", "total_records", "count(*)")]
            + [_tidy_sql("nulls", f"{c}_nulls", f"count(*) - count({c})") for c in columns]
            + [_tidy_sql("consistency", n, f"count(*) FILTER (WHERE {e})")
               for n, e in RULES.items()]
            + [_tidy_sql("duplicates", "duplicate_records", f"{TOTAL} - k", DUPES),
               _tidy_sql("duplicates", "duplicate_percentage", f"({TOTAL} - k) / {TOTAL} * 100",
                         DUPES)])


@query("agg_quality_report", "\nUNION ALL ".join(_quality_sql(PANEL_COLUMNS)))
def _(t):
    return quality.quality_report(t.panel, AS_OF)


UNIQUES = [_tidy_sql("totals", "unique_policies", "count(DISTINCT policy)"),
           _tidy_sql("totals", "unique_vehicles", "count(DISTINCT vehicle_no)"),
           _tidy_sql("totals", "unique_drivers", "count(DISTINCT driver_no)")]


@query("agg_validate_panel", "\nUNION ALL ".join(
    [_tidy_sql("totals", "total_records", "count(*)")] + UNIQUES
    + [_tidy_sql("nulls", f"{c}_nulls", f"count(*) - count({c})") for c in KEYS]
    + [_tidy_sql("range", "first_period", "min(inforce_yy * 100 + inforce_mm)"),
       _tidy_sql("range", "last_period", "max(inforce_yy * 100 + inforce_mm)"),
       _tidy_sql("columns", "premium_paid_count", "count(premium_paid)"),
       _tidy_sql("columns", "premium_paid_mean", PAID_MEAN),
       _tidy_sql("columns", "premium_paid_stddev", dev("premium_paid")),
       _tidy_sql("columns", "premium_paid_min", "min(premium_paid)"),
       _tidy_sql("columns", "premium_paid_max", "max(premium_paid)")]))
def _(t):
    return quality.validate_panel(t.panel).withColumn(
        "value", F.when(F.col("metric").endswith("stddev"), F.round("value", 4))
        .otherwise(F.col("value")))


def _keyed(sql: str, key: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT section, metric, {key} AS key, value FROM ({sql}) q"


def _columns_sql(section: str, inner: str) -> str:
    return f"SELECT '{section}' AS section, metric, column_name AS key, value FROM ({inner}) q"


def _trend_sql(section: str, key: str, by: str, metrics: dict) -> list[str]:
    return [f"SELECT '{section}' AS section, '{m}' AS metric, {key} AS key, "
            f"CAST({e} AS DOUBLE) AS value FROM fx_panel GROUP BY {by}" for m, e in metrics.items()]


_TRENDS = {"record_count": "count(*)", "unique_policies": "count(DISTINCT policy)",
           "avg_premium": PAID_MEAN}
_YEARS = dict(_TRENDS, unique_vehicles="count(DISTINCT vehicle_no)",
              unique_drivers="count(DISTINCT driver_no)", total_premium=PAID_SUM)
_PM = ("(SELECT policy, count(*) AS record_count, count(DISTINCT vehicle_no) AS vehicle_count, "
       f"count(DISTINCT driver_no) AS driver_count, {PAID_MEAN} AS avg_premium "
       "FROM fx_panel GROUP BY policy) m")
_VM = (f"(SELECT vehicle_no, count(*) AS record_count, count(DISTINCT driver_no) AS driver_count, "
       f"{PAID_MEAN} AS avg_premium FROM fx_panel GROUP BY vehicle_no) m")

PROFILE = "\nUNION ALL ".join(
    [_keyed(s) for s in _quality_sql(KEYS) + UNIQUES + [
        _tidy_sql("range", "min_year", "min(inforce_yy)"),
        _tidy_sql("range", "max_year", "max(inforce_yy)"),
        _tidy_sql("range", "min_month", "min(inforce_mm)"),
        _tidy_sql("range", "max_month", "max(inforce_mm)")]]
    + [_columns_sql("columns", described("fx_panel", c,
                                         f"round({PAID_MEAN if c == 'premium_paid' else f'avg({c})'}, 4)"))
       for c in ("premium_paid", "driver_age", "client_tenure_days", "model_year")]
    + [f"SELECT 'top_values' AS section, '{c}' AS metric, {c} AS key, CAST(count(*) AS DOUBLE) AS value "
       f"FROM fx_panel GROUP BY {c}" for c in ("vehicle_type", "driver_type", "assignment_type")]
    + _trend_sql("monthly", "inforce_yy || '-' || lpad(CAST(inforce_mm AS VARCHAR), 2, '0')",
                 "inforce_yy, inforce_mm", _TRENDS)
    + _trend_sql("yearly", "CAST(inforce_yy AS VARCHAR)", "inforce_yy", _YEARS)
    + ["SELECT 'columns' AS section, 'median' AS metric, 'premium_paid' AS key, "
       "CAST(quantile_cont(premium_paid, 0.5) AS DOUBLE) AS value FROM fx_panel"]
    + [_columns_sql("policy_metrics", described(_PM, c, f"round(avg({c}), 4)"))
       for c in ("record_count", "vehicle_count", "driver_count", "avg_premium")]
    + [_columns_sql("vehicle_metrics", described(_VM, c, f"round(avg({c}), 4)"))
       for c in ("record_count", "driver_count", "avg_premium")])


@query("agg_profile_overview", PROFILE)
def _(t):
    out = quality.profile_overview(t.panel, AS_OF)
    return out.withColumn("value", F.when(F.col("metric").isin("stddev", "mean"),
                                          F.round("value", 4)).otherwise(F.col("value")))


@query("proj_period_key", """
SELECT policy, vehicle_vin, inforce_yy * 100 + inforce_mm AS period FROM fx_panel""")
def _(t):
    return t.panel.select("policy", "vehicle_vin", period().alias("period"))
