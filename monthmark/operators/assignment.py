"""Assigning drivers to vehicles within families.

Drivers and vehicles are ranked per family and matched by equality on (family, slot).
Ranks are taken per prefix bucket with offsets, so a family of any size is never one task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.functions.columns import padded
from monthmark.functions.ranking import bucketed_rank, prefix_bucket
from monthmark.functions.skew import salted_join
from monthmark.operators.rating import stored_premiums
from monthmark.params import Params


def _sizes(vehicles: DataFrame, drivers: DataFrame) -> DataFrame:
    """Vehicle and driver counts per family."""
    one = lambda df, v: df.select("family_id", F.lit(v).alias("_v"), F.lit(1 - v).alias("_d"))
    return one(vehicles, 1).unionByName(one(drivers, 0)).groupBy("family_id").agg(
        F.sum("_v").alias("vehicles"), F.sum("_d").alias("drivers"))


def _vehicle_slots(vehicles: DataFrame) -> DataFrame:
    return bucketed_rank(vehicles.select("family_id", "vehicle_no"), ["family_id"],
                         [F.col("vehicle_no")], prefix_bucket(vehicles, "vehicle_no"), "v_slot")


def _teen(params: Params, age: str = "age") -> Column:
    return F.coalesce(F.col(age), F.lit(0)) <= params.teen_max_age


def _assignment_no(n: Column) -> Column:
    """ASS and a number of at least eight digits."""
    return F.concat(F.lit("ASS"), padded(n, 8))


def initial_assignments(vehicles: DataFrame, drivers: DataFrame, params: Params) -> DataFrame:
    """First assignment of every family.

    Adults come before teens, each by number. Every vehicle gets the primary of its slot;
    vehicles beyond the drivers go to the first driver. Drivers beyond the vehicles become
    secondaries, going round the vehicles; an adult one makes that vehicle's primary shared.
    With as many drivers as vehicles each young driver is also a secondary of the first
    vehicle, whose primary is then shared. A family without vehicles keeps its drivers
    unassigned.
    """
    e = params.exposures
    order_key = F.concat(F.when(F.col("driver_type") == "adult", "0").otherwise("1"), "driver_no")
    people = drivers.where(F.col("driver_type").isin("adult", "teen")).select(
        "family_id", "driver_no", "age", order_key.alias("_order"))
    d = bucketed_rank(people, ["family_id"], [F.col("_order")], prefix_bucket(people, "_order"), "d_slot")
    sizes = _sizes(vehicles, people)
    d = salted_join(d, sizes, ["family_id"], ["driver_no"], counts=sizes.select("family_id", F.col("drivers").alias("n")))
    v = salted_join(_vehicle_slots(vehicles), sizes, ["family_id"], ["vehicle_no"],
                    counts=sizes.select("family_id", F.col("vehicles").alias("n")))

    spare = (F.col("drivers") > F.col("vehicles")) & (F.col("d_slot") >= F.col("vehicles"))
    young = (F.col("drivers") == F.col("vehicles")) & _teen(params)
    extra = d.where(spare | young)
    role = F.when(F.col("vehicles") == 0, "unassigned") \
        .when(_teen(params), "secondary_teen").otherwise("secondary_adult")
    extra = extra.select(
        "family_id", "driver_no", "d_slot", "vehicles", "drivers", "_order",
        role.alias("assignment_type"),
        F.when(F.col("drivers") == F.col("vehicles"), F.lit(0))
        .otherwise(F.try_mod(F.col("d_slot") - F.col("vehicles"), F.col("vehicles")))
        .alias("v_slot"))
    # The position among a family's young secondaries numbers their assignments.
    extra = bucketed_rank(extra, ["family_id"], [F.col("_order")], prefix_bucket(people, "_order"),
                          "_position")
    seconds = extra.join(_vehicle_slots(vehicles), ["family_id", "v_slot"], "left").select(
        "family_id",
        _assignment_no(F.col("vehicles") + F.col("_position") + 1).alias("assignment_id"),
        F.coalesce("vehicle_no", F.lit("UNASSIGNED")).alias("vehicle_no"), "driver_no",
        "assignment_type",
        F.when(F.col("assignment_type") == "unassigned", 0.0)
        .when(F.col("assignment_type") == "secondary_teen", e.teen_secondary)
        .otherwise(e.secondary_adult).alias("exposure_factor"))

    shares = (extra.where((F.col("vehicles") > 0) & (
                (F.col("assignment_type") == "secondary_adult")
                | (F.col("drivers") == F.col("vehicles"))))
              .select("family_id", "v_slot").distinct().withColumn("_shared", F.lit(True)))
    slot = F.when(F.col("v_slot") < F.col("drivers"), F.col("v_slot")).otherwise(F.lit(0))
    primaries = (v.withColumn("d_slot", slot)
                 .join(d.select("family_id", "d_slot", "driver_no"), ["family_id", "d_slot"])
                 .join(shares, ["family_id", "v_slot"], "left")
                 .select("family_id", _assignment_no(F.col("v_slot") + 1).alias("assignment_id"),
                         "vehicle_no", "driver_no", F.lit("primary").alias("assignment_type"),
                         F.when(F.col("_shared"), e.primary_shared).otherwise(e.primary_solo)
                         .alias("exposure_factor")))
    return primaries.unionByName(seconds)


def reassign(vehicles: DataFrame, drivers: DataFrame, params: Params, on: date) -> DataFrame:
    """New assignments of the active vehicles and drivers of a family, youngest first.

    As many drivers as vehicles pair off; vehicles beyond the drivers go round them. With more
    drivers every vehicle also gets as secondary the first driver that is not its primary,
    and an adult secondary makes the primary shared.
    """
    e = params.exposures
    v = _vehicle_slots(vehicles.where(F.col("status") == "active"))
    people = drivers.where(F.col("status") == "active").select("family_id", "driver_no", "age")
    d = bucketed_rank(people, ["family_id"], [F.col("age"), F.col("driver_no")],
                      F.concat(padded(F.coalesce("age", F.lit(0)), 10),
                               prefix_bucket(people, "driver_no")), "d_slot")
    sizes = _sizes(v, people).where("vehicles > 0 AND drivers > 0")
    v = salted_join(v, sizes, ["family_id"], ["vehicle_no"], counts=sizes.select("family_id", F.col("vehicles").alias("n")))
    more = F.col("drivers") > F.col("vehicles")
    by_slot = d.select("family_id", "d_slot", "driver_no", "age")

    second = v.where(more).withColumn(
        "d_slot", F.when(F.col("v_slot") == 0, F.lit(1)).otherwise(F.lit(0))) \
        .join(by_slot, ["family_id", "d_slot"]).select(
            "family_id", "vehicle_no", "v_slot", "driver_no",
            F.when(_teen(params), "secondary_teen").otherwise("secondary_adult")
            .alias("assignment_type"),
            F.when(_teen(params), e.teen_secondary).otherwise(e.secondary_adult)
            .alias("exposure_factor"))
    shared = second.where(F.col("assignment_type") == "secondary_adult").select(
        "family_id", "v_slot", F.lit(True).alias("_shared"))
    first = (v.withColumn("d_slot", F.col("v_slot") % F.col("drivers"))
             .join(by_slot, ["family_id", "d_slot"])
             .join(shared, ["family_id", "v_slot"], "left")
             .select("family_id", "vehicle_no", "v_slot", "driver_no",
                     F.lit("primary").alias("assignment_type"),
                     F.when(F.col("_shared"), e.primary_shared).otherwise(F.lit(e.primary_solo))
                     .alias("exposure_factor")))
    return first.unionByName(second).select(
        F.concat(F.lit("ASS"), "family_id", "vehicle_no", "driver_no").alias("assignment_id"),
        "family_id", "vehicle_no", "driver_no", "assignment_type", "exposure_factor",
        F.lit(on).cast("date").alias("effective_date"),
        F.lit(None).cast("date").alias("end_date"), F.lit("active").alias("status"))


def close_for_reassignment(assignments: DataFrame, reassigned: DataFrame, on: date) -> DataFrame:
    """Active assignments of reassigned families end on the day of the reassignment."""
    families = reassigned.select("family_id").distinct().withColumn("_re", F.lit(True))
    closes = F.col("_re") & (F.col("status") == "active")
    joined = assignments.join(families, "family_id", "left")
    return joined.withColumns({
        "end_date": F.when(closes, F.lit(on).cast("date")).otherwise(F.col("end_date")),
        "status": F.when(closes, "removed").otherwise(F.col("status"))}).select(
            *assignments.columns)


def with_stored_premiums(new: DataFrame, vehicles: DataFrame, drivers: DataFrame, params: Params,
                         kind: str = "driver_reassignment") -> DataFrame:
    from monthmark.operators.rating import rating_rows

    rated = rating_rows(new, vehicles, drivers)
    return stored_premiums(rated, params, kind).select(*new.columns, "annual_premium_rate",
                                                       "annual_premium_paid")


def assignment_violations(assignments: DataFrame, vehicles: DataFrame, drivers: DataFrame,
                          params: Params) -> DataFrame:
    """Broken assignment rules as (family_id, subject, subject_no, rule, observed) rows."""
    live = assignments.where(F.col("status") == "active") if "status" in assignments.columns \
        else assignments
    active = lambda df: df.where(F.col("status") == "active")
    per_vehicle = live.groupBy("family_id", "vehicle_no").agg(
        F.count_if(F.col("assignment_type") == "primary").alias("primaries"),
        F.count_distinct("driver_no").alias("people"))
    v = active(vehicles).select("family_id", "vehicle_no").join(
        per_vehicle, ["family_id", "vehicle_no"], "left").withColumns({
            "primaries": F.coalesce("primaries", F.lit(0)),
            "people": F.coalesce("people", F.lit(0))})
    row = lambda df, subject, no, rule, n: df.select(
        "family_id", F.lit(subject).alias("subject"), F.col(no).alias("subject_no"),
        F.lit(rule).alias("rule"), F.col(n).alias("observed"))
    primary = row(v.where("primaries <> 1"), "vehicle", "vehicle_no", "one_primary", "primaries")
    crowd = row(v.where(F.col("people") > params.max_drivers_per_vehicle), "vehicle",
                "vehicle_no", "max_drivers", "people")
    held = live.where(F.col("vehicle_no") != "UNASSIGNED").select(
        "family_id", "driver_no").distinct()
    idle = row(active(drivers).join(held, ["family_id", "driver_no"], "left_anti")
               .withColumn("n", F.lit(0).cast("long")), "driver", "driver_no", "driver_assigned",
               "n")
    loose = row(live.where(F.col("assignment_type") == "unassigned")
                .withColumn("n", F.lit(1).cast("long")), "driver", "driver_no", "no_unassigned",
                "n")
    return primary.unionByName(crowd).unionByName(idle).unionByName(loose)
