"""Building the month-end panel from effective-dated masters.

Months are handled as whole numbers (months since year 0). A validity interval becomes the
range of months whose end lies in it, the ranges of assignment, vehicle, driver and policy
are intersected row by row after equality joins, and only the result is exploded: there is
no range join, and the joins run on intervals instead of on months times intervals.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.functions.columns import (as_col, index_month, index_of_date, index_year,
                                         month_end)
from monthmark.functions.skew import salted_join
from monthmark.operators.rating import assignment_rate, paid
from monthmark.params import Params
from monthmark.schema import PANEL_COLUMNS

FAR = 12 * 9999  # an open end, as a month index


def spine_bounds(params: Params) -> tuple[int, int]:
    """First and last month of the run as month indexes."""
    of = lambda d: d.year * 12 + d.month - 1
    return of(params.start), of(params.end)


def first_month(effective: str | Column) -> Column:
    """Index of the first month whose end is on or after a date."""
    return index_of_date(effective)


def last_month(end: str | Column) -> Column:
    """Index of the last month whose end is before a date; open when the date is null.

    The end of the date's own month is never before the date.
    """
    return F.coalesce(index_of_date(end) - 1, F.lit(FAR))


def assignment_ranges(assignments: DataFrame, params: Params) -> DataFrame:
    """Assignments with the months (lo..hi) they are active in at month end.

    Effective dates are inclusive, end dates exclusive; rows without a month are dropped,
    which also keeps the later sequence from counting backwards.
    """
    lo, hi = spine_bounds(params)
    return assignments.where(F.col("effective_date").isNotNull()).withColumns({
        "lo": F.greatest(first_month("effective_date"), F.lit(lo)),
        "hi": F.least(last_month("end_date"), F.lit(hi))}).where("lo <= hi")


def vehicle_ranges(vehicles: DataFrame, params: Params) -> DataFrame:
    """Vehicle versions with non-overlapping month ranges per (family, number).

    Where versions overlap the one effective first wins. With versions ordered that way a
    version only gets the months after every earlier version has ended, so a running maximum
    of the ends replaces a comparison per month. Versions with equal ranges are reduced to the
    winning one beforehand, which bounds a key's window by the number of month ranges.
    """
    lo, hi = spine_bounds(params)
    active = F.col("status") == "active"
    leaves = (F.col("status") == "removed") & F.col("removal_date").isNotNull()
    dated = F.col("effective_date").isNotNull()
    ranged = vehicles.where(dated & (active | leaves)).withColumns({
        "lo": F.greatest(first_month("effective_date"), F.lit(lo)),
        "hi": F.least(F.when(active, F.lit(FAR)).otherwise(last_month("removal_date")),
                      F.lit(hi))}).where("lo <= hi")
    version = F.struct("effective_date", "vin", "vehicle_type", "model_year")
    winners = ranged.groupBy("family_id", "vehicle_no", "lo", "hi").agg(F.min(version).alias("v"))
    before = (Window.partitionBy("family_id", "vehicle_no")
              .orderBy("v", "lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    return (winners.withColumn("lo", F.greatest(
                "lo", F.coalesce(F.max("hi").over(before) + 1, F.lit(lo))))
            .where("lo <= hi")
            .select("family_id", "vehicle_no", "lo", "hi", "v.vin", "v.vehicle_type",
                    "v.model_year"))


def first_drivers(drivers: DataFrame) -> DataFrame:
    """The driver of each (family, number): the first to become effective.

    A driver stays valid once effective, so the earliest is the match of every later month.
    """
    c = drivers.columns
    licence = F.coalesce(*[F.col(n) for n in ("license_no", "driver_license_no") if n in c])
    row = F.struct(
        "effective_date", licence.alias("driver_license_no"), "driver_name", "driver_type",
        F.coalesce("age_at_issuance", "age").alias("driver_age"))
    return (drivers.where(F.col("effective_date").isNotNull())
            .groupBy("family_id", "driver_no").agg(F.min(row).alias("d"))
            .select("family_id", "driver_no", "d.*")
            .withColumn("driver_from", first_month("effective_date")).drop("effective_date"))


def first_cancellations(changes_log: DataFrame) -> DataFrame:
    """Date of the first logged cancellation per family."""
    return (changes_log.where(F.col("change_type") == "policy_cancellation")
            .groupBy("family_id").agg(F.min("date").alias("cancel_date")))


def policy_ranges(policies: DataFrame, changes_log: DataFrame, params: Params) -> DataFrame:
    """Policies with the last month they are in force.

    A cancelled policy leaves with the first month end on or after its logged cancellation;
    without a log entry it stays.
    """
    out = policies.join(first_cancellations(changes_log), "family_id", "left")
    gone = F.when(F.col("status") == "cancelled", F.col("cancel_date"))
    _, hi = spine_bounds(params)
    return out.withColumn("policy_hi", F.least(last_month(gone), F.lit(hi)))


def explode_months(ranged: DataFrame) -> DataFrame:
    """One row per month of each (lo, hi) range, with calendar columns; no shuffle."""
    return (ranged.where("lo <= hi")
            .withColumn("_m", F.explode(F.sequence("lo", "hi")))
            .withColumns({"inforce_yy": index_year("_m"), "inforce_mm": index_month("_m")})
            .drop("_m", "lo", "hi"))


def in_force_assignments(policies: DataFrame, changes_log: DataFrame, assignments: DataFrame,
                         params: Params) -> DataFrame:
    """Ranges of assignments cut to the policy's time in force."""
    held = policy_ranges(policies, changes_log, params).select(
        "family_id", F.col("policy_no").alias("policy"),
        F.col("current_expiry_date").alias("policy_expiry_date"), "start_date", "policy_hi")
    keep = ["family_id", "vehicle_no", "driver_no", "assignment_type", "exposure_factor",
            "lo", "hi"]
    ranges = assignment_ranges(assignments, params).select(*keep)
    return (salted_join(ranges, held, ["family_id"], ["vehicle_no", "driver_no", "lo"])
            .withColumn("hi", F.least("hi", "policy_hi")).drop("policy_hi").where("lo <= hi"))


def with_vehicle(ranged: DataFrame, vehicles: DataFrame, params: Params) -> DataFrame:
    """Intersect ranges with the vehicle valid at month end; no vehicle, no row."""
    v = vehicle_ranges(vehicles, params).withColumnsRenamed({"lo": "v_lo", "hi": "v_hi"})
    return (ranged.join(v, ["family_id", "vehicle_no"])
            .withColumns({"lo": F.greatest("lo", "v_lo"), "hi": F.least("hi", "v_hi")})
            .drop("v_lo", "v_hi").where("lo <= hi"))


def with_driver(ranged: DataFrame, drivers: DataFrame) -> DataFrame:
    """Intersect ranges with the driver valid at month end; no driver, no row."""
    return (ranged.join(first_drivers(drivers), ["family_id", "driver_no"])
            .withColumn("lo", F.greatest("lo", "driver_from"))
            .drop("driver_from").where("lo <= hi"))


def build_panel(policies: DataFrame, vehicles: DataFrame, drivers: DataFrame,
                assignments: DataFrame, changes_log: DataFrame, params: Params) -> DataFrame:
    """The 18-column month-end panel for all months of the run, as one plan."""
    ranged = in_force_assignments(policies, changes_log, assignments, params)
    ranged = with_driver(with_vehicle(ranged, vehicles, params), drivers)
    months = explode_months(ranged)
    rated = months.withColumns({
        "client_tenure_days": F.datediff(month_end(), "start_date"),
        "premium_rate": assignment_rate(params, F.col("inforce_yy"))})
    return (rated.withColumn("premium_paid", paid("premium_rate", "exposure_factor"))
            .withColumnRenamed("vin", "vehicle_vin").select(*PANEL_COLUMNS))


def tenure_days(df: DataFrame, start: str = "start_date") -> DataFrame:
    return df.withColumn("client_tenure_days", F.datediff(month_end(), as_col(start)))
