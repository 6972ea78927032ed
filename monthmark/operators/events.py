"""Applying the change log to the master tables, and renewals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthmark.functions.columns import age_at
from monthmark.params import Params

# The event types of the change log.
VEHICLE_REMOVALS = ("vehicle_removal", "policy_cancellation")
DRIVER_REMOVALS = ("adult_removal", "teen_removal")


def _earliest(log: DataFrame, kinds: tuple[str, ...], key: str) -> DataFrame:
    if key not in log.columns:  # a log without such events
        log = log.withColumn(key, F.lit(None).cast("string"))
    return (log.where(F.col("change_type").isin(*kinds) & F.col(key).isNotNull())
            .groupBy("family_id", key).agg(F.min("date").alias("_gone")))


def remove_vehicles(vehicles: DataFrame, log: DataFrame) -> DataFrame:
    """Active vehicles with a logged removal become removed on its date."""
    if "removal_date" not in vehicles.columns:
        vehicles = vehicles.withColumn("removal_date", F.lit(None).cast("date"))
    joined = vehicles.join(_earliest(log, VEHICLE_REMOVALS, "vehicle_no"),
                           ["family_id", "vehicle_no"], "left")
    hit = (F.col("status") == "active") & F.col("_gone").isNotNull()
    return joined.withColumns({
        "removal_date": F.when(hit, F.col("_gone")).otherwise(F.col("removal_date")),
        "status": F.when(hit, "removed").otherwise(F.col("status"))}).select(*vehicles.columns)


def remove_drivers(drivers: DataFrame, log: DataFrame) -> DataFrame:
    joined = drivers.join(_earliest(log, DRIVER_REMOVALS, "driver_no"),
                          ["family_id", "driver_no"], "left")
    hit = (F.col("status") == "active") & F.col("_gone").isNotNull()
    return joined.withColumn("status", F.when(hit, "removed").otherwise(F.col("status"))).select(
        *drivers.columns)


def close_assignments(assignments: DataFrame, log: DataFrame) -> DataFrame:
    """Active assignments of a removed vehicle or driver end on the removal's date.

    An assignment made after the removal is not touched; with both removed the earlier counts.
    """
    v = _earliest(log, VEHICLE_REMOVALS, "vehicle_no").withColumnRenamed("_gone", "_v")
    d = _earliest(log, DRIVER_REMOVALS, "driver_no").withColumnRenamed("_gone", "_d")
    after = lambda c: F.when(F.col(c) >= F.col("effective_date"), F.col(c))
    joined = (assignments.join(v, ["family_id", "vehicle_no"], "left")
              .join(d, ["family_id", "driver_no"], "left")
              .withColumn("_gone", F.least(after("_v"), after("_d"))))
    hit = (F.col("status") == "active") & F.col("_gone").isNotNull()
    return joined.withColumns({
        "end_date": F.when(hit, F.col("_gone")).otherwise(F.col("end_date")),
        "status": F.when(hit, "removed").otherwise(F.col("status"))}).select(*assignments.columns)


def empty_families(vehicles: DataFrame) -> DataFrame:
    """Families without an active vehicle, with the date and vehicle of the last removal."""
    last = F.max(F.struct("removal_date", "vehicle_no"))
    return vehicles.groupBy("family_id").agg(
        F.count_if(F.col("status") == "active").alias("_active"), last.alias("last")).where(
            "_active = 0").select("family_id", F.col("last.removal_date").alias("date"),
                                  F.col("last.vehicle_no").alias("vehicle_no"))


def cancel_empty(table: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Status 'cancelled' for the policies (or families) without an active vehicle."""
    empty = empty_families(vehicles).select("family_id", F.lit(True).alias("_empty"))
    return table.join(empty, "family_id", "left").withColumn(
        "status", F.when(F.col("_empty"), "cancelled").otherwise(F.col("status"))).select(
            *table.columns)


def cancellation_events(vehicles: DataFrame) -> DataFrame:
    return empty_families(vehicles).select(
        F.lit("policy_cancellation").alias("change_type"), "date", "family_id", "vehicle_no",
        F.lit("all_vehicles_removed").alias("reason"))


def vehicle_versions(vehicles: DataFrame, substitutions: DataFrame) -> DataFrame:
    """Vehicles and their substitutes as versions with [valid_from, valid_to) ranges.

    `substitutions` has (family_id, vehicle_no, date, vin, vehicle_type, model_year). Keeping
    versions leaves every month with the vehicle it had; overwriting would not. One version
    per day is kept before the window, which bounds a vehicle's window by days.
    """
    cols = ["vin", "vehicle_type", "model_year"]
    first = vehicles.select("family_id", "vehicle_no", F.col("effective_date").alias("valid_from"),
                            F.lit(0).alias("_seq"), *cols)
    later = substitutions.select("family_id", "vehicle_no", F.col("date").alias("valid_from"),
                                 F.lit(1).alias("_seq"), *cols)
    daily = first.unionByName(later).groupBy("family_id", "vehicle_no", "valid_from").agg(
        F.max(F.struct("_seq", *cols)).alias("v"))
    w = Window.partitionBy("family_id", "vehicle_no").orderBy("valid_from")
    return daily.select("family_id", "vehicle_no", *[F.col(f"v.{c}").alias(c) for c in cols],
                        "valid_from", F.lead("valid_from").over(w).alias("valid_to"))


def current_vehicles(versions: DataFrame) -> DataFrame:
    """The overwritten form: only the last version of each vehicle."""
    return versions.where(F.col("valid_to").isNull()).drop("valid_to")


def tenure_resets(policies: DataFrame, log: DataFrame) -> DataFrame:
    """Last day a substitution with a coverage gap reset the tenure of a policy."""
    resets = (log.where((F.col("change_type") == "vehicle_substitution")
                        & F.coalesce("tenure_reset", F.lit(False)))
              .groupBy("family_id").agg(F.max("date").alias("tenure_from")))
    return policies.join(resets, "family_id", "left").withColumn(
        "tenure_from", F.coalesce("tenure_from", "start_date"))


def renewals(policies: DataFrame, params: Params, mode: str = "exact_first_of_month") -> DataFrame:
    """Renewal events of active policies, each a term of days after the one before.

    Processing happens on the first of a month. In the exact mode a policy renews only when
    its expiry is such a day, and a missed renewal ends the chain; 'in_month' renews whenever
    the expiry falls into the run.
    """
    if mode not in ("exact_first_of_month", "in_month"):
        raise ValueError(f"unknown renewal mode: {mode}")
    expiry, end = F.col("current_expiry_date"), F.lit(params.end).cast("date")
    live = policies.where((F.col("status") == "active") & (expiry <= end)
                          & (expiry >= F.lit(params.start).cast("date")))
    steps = F.sequence(F.lit(0), F.floor(F.datediff(end, expiry) / params.term_days).cast("int"))
    if mode == "exact_first_of_month":
        day = lambda k: F.dayofmonth(F.date_add(expiry, k * params.term_days))
        missed = F.array_position(F.transform(steps, lambda k: day(k) != 1), True)
        steps = F.when(missed == 0, steps).otherwise(F.slice(steps, F.lit(1), (missed - 1).cast("int")))
    out = live.withColumn("_k", F.explode(steps)).withColumn(
        "old_expiry_date", F.date_add(expiry, F.col("_k") * params.term_days))
    return out.select(
        F.lit("policy_renewal").alias("change_type"),
        (F.col("old_expiry_date") if mode == "exact_first_of_month"
         else F.trunc("old_expiry_date", "MM")).alias("date"),
        "family_id", "policy_no", "old_expiry_date",
        F.date_add("old_expiry_date", params.term_days).alias("new_expiry_date"),
        F.lit("annual_renewal").alias("reason"))


def renewed_policies(policies: DataFrame, events: DataFrame) -> DataFrame:
    """Policies with the expiry their last renewal gave them."""
    last = events.groupBy("policy_no").agg(F.max("new_expiry_date").alias("_new"))
    return policies.join(last, "policy_no", "left").withColumn(
        "current_expiry_date", F.coalesce("_new", "current_expiry_date")).select(
            *policies.columns)


def renewed_drivers(drivers: DataFrame, events: DataFrame) -> DataFrame:
    """Active drivers with both ages set to the age at their family's last renewal."""
    last = events.groupBy("family_id").agg(F.max("date").alias("_on"))
    hit = (F.col("status") == "active") & F.col("_on").isNotNull()
    new = age_at("birthday", "_on")
    return drivers.join(last, "family_id", "left").withColumns({
        "age": F.when(hit, new).otherwise(F.col("age")),
        "age_at_issuance": F.when(hit, new).otherwise(F.col("age_at_issuance"))}).select(
            *drivers.columns)


def events_in_month(log: DataFrame, year: int, month: int, family: str | None = None) -> DataFrame:
    """Logged events of a month, of one family or all."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    out = log.where((F.col("date") >= first) & (F.col("date") <= F.last_day(first)))
    return out if family is None else out.where(F.col("family_id") == family)


def union_logs(*logs: DataFrame) -> DataFrame:
    """Logs of different event types in one table; missing columns are null."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out
