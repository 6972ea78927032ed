"""Rating of assignments and policies.

Factors are column expressions built from the parameters, so a rate is computed inside the
scan's code without a join. Table-driven lookups are offered for factors kept as data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.functions.columns import (EXACT, as_col, basis_points, half_up, named_factor,
                                         step_factor)
from monthmark.params import Params

# Assignment kinds rated at the age of issuance.
ISSUANCE_KINDS = ("vehicle_substitution", "driver_reassignment", "existing_assignment")


def role_factor(params: Params, assignment_type: str | Column = "assignment_type") -> Column:
    """Factor of the role; an adult secondary is rated as 'secondary', others by name or 1."""
    role = as_col(assignment_type)
    role = F.when(role == "secondary_adult", F.lit("secondary")).otherwise(role)
    return named_factor(role, params.role_factors)


def inflation_factor(params: Params, year: Column) -> Column:
    return F.pow(F.lit(1 + params.inflation), year - params.base_year)


def raw_rate(params: Params, year: Column, age: str = "driver_age") -> Column:
    return (F.lit(params.base_amount) * named_factor("vehicle_type", params.vehicle_factors)
            * step_factor(age, params.age_factors) * role_factor(params)
            * inflation_factor(params, year))


def assignment_rate(params: Params, year: Column, age: str = "driver_age") -> Column:
    """Annual rate before exposure, rounded to cents."""
    return half_up(raw_rate(params, year, age))


def paid(rate: str | Column, exposure: str | Column) -> Column:
    """Rate times exposure, rounded again (the panel's premium)."""
    return half_up(as_col(rate) * as_col(exposure))


def rating_age(kind: str | Column, issued: str = "age_at_issuance", current: str = "age") -> Column:
    """Issuance age for existing, reassigned and substituted assignments, else current age."""
    kind = as_col(kind) if isinstance(kind, Column) else F.lit(kind)
    return F.when(kind.isin(*ISSUANCE_KINDS), F.coalesce(issued, current)).otherwise(
        F.col(current))


def stored_premiums(rated: DataFrame, params: Params, kind: str | Column = "existing_assignment",
                    on: str = "effective_date") -> DataFrame:
    """annual_premium_paid and annual_premium_rate as stored with an assignment.

    The rate is not rounded before the exposure is applied; the stored rate is the paid
    amount over the exposure (null for no exposure).
    """
    aged = rated.withColumn("_age", rating_age(kind))
    amount = half_up(raw_rate(params, F.year(on), "_age") * F.col("exposure_factor"))
    return aged.withColumn("annual_premium_paid", amount).withColumn(
        "annual_premium_rate",
        half_up(F.try_divide(F.col("annual_premium_paid"), F.col("exposure_factor")))).drop("_age")


def first_match(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the first in the given order, by a combinable aggregate."""
    row = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in columns])


def rating_rows(assignments: DataFrame, vehicles: DataFrame, drivers: DataFrame) -> DataFrame:
    """Assignments with the first vehicle and driver of their numbers."""
    v = first_match(vehicles, ["family_id", "vehicle_no"], ["effective_date", "vin"],
                    ["vehicle_type", "model_year"])
    d = first_match(drivers, ["family_id", "driver_no"], ["effective_date", "driver_name"],
                    ["driver_type", "age", "age_at_issuance"])
    return assignments.join(v, ["family_id", "vehicle_no"]).join(d, ["family_id", "driver_no"])


def live_assignments(assignments: DataFrame) -> DataFrame:
    return assignments.where((F.col("status") == "active") & (F.col("exposure_factor") > 0))


def total_exposures(assignments: DataFrame) -> DataFrame:
    """(family_id, total_exposure) of active assignments with exposure."""
    return live_assignments(assignments).groupBy("family_id").agg(
        (F.sum(basis_points("exposure_factor")) / 10000).alias("total_exposure"))


def policy_exposures(policies: DataFrame, assignments: DataFrame) -> DataFrame:
    """Total exposure per policy, 0 without an assignment."""
    return policies.join(total_exposures(assignments), "family_id", "left").select(
        "policy_no", F.coalesce("total_exposure", F.lit(0.0)).alias("total_exposure"))


def policy_premiums(policies: DataFrame, assignments: DataFrame, vehicles: DataFrame,
                    drivers: DataFrame, params: Params) -> DataFrame:
    """Calculated premium and total exposure per policy.

    The premium sums base x exposure x vehicle x age x driver-type factors over active
    assignments with exposure that have a vehicle and a driver, without inflation, and is at
    least the minimum premium. The exposure counts all active assignments with exposure.
    """
    live, exposure = live_assignments(assignments), total_exposures(assignments)
    amount = (F.lit(params.base_amount) * F.col("exposure_factor")
              * named_factor("vehicle_type", params.vehicle_factors)
              * step_factor("age", params.age_factors)
              * named_factor("driver_type", params.role_factors))
    rated = (rating_rows(live.select("family_id", "vehicle_no", "driver_no", "exposure_factor"),
                         vehicles, drivers)
             .groupBy("family_id").agg(F.sum(amount.try_cast("decimal(28,10)")).alias("_amount")))
    return (policies.join(exposure, "family_id", "left").join(rated, "family_id", "left")
            .select("policy_no", "family_id", "status",
                    F.col("premium_paid").alias("stored_premium"),
                    half_up(F.greatest(F.coalesce("_amount", F.lit(0).cast(EXACT)),
                                       F.lit(params.minimum_premium).cast(EXACT)))
                    .alias("calculated_premium"),
                    F.coalesce("total_exposure", F.lit(0.0)).alias("total_exposure")))


def multi_vehicle_discount(vehicles: DataFrame, params: Params) -> DataFrame:
    """Discount by the number of active vehicles of a family (optional, off by default)."""
    counts = vehicles.where(F.col("status") == "active").groupBy("family_id").agg(
        F.count_distinct("vehicle_no").alias("active_vehicles"))
    return counts.withColumn("discount", step_factor(
        "active_vehicles", params.multi_vehicle_discounts, default=0.0))


def yearly_increase(policies: DataFrame, params: Params, year: int) -> DataFrame:
    """Active premiums raised once a year up to `year`, rounded to cents every time."""
    steps = max(0, year - params.base_year)
    start = F.col("premium_paid").cast("double")
    if steps:
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start,
                            lambda acc, _: half_up(acc * (1 + params.inflation)))
    else:
        grown = start
    return policies.withColumn("premium_paid",
                               F.when(F.col("status") == "active", grown).otherwise(start))


# --- factors kept as tables ---------------------------------------------------------------

def join_named_factor(df: DataFrame, factors: DataFrame, key: str, name: str,
                      default: float = 1.0) -> DataFrame:
    """Left join of a (key, factor) table with a default for names without a factor.

    Which side is broadcast is left to the size known at run time.
    """
    f = factors.select(F.col(key), F.col("factor").alias("_factor"))
    return df.join(f, key, "left").withColumn(
        name, F.coalesce("_factor", F.lit(default))).drop("_factor")


def dense_steps(steps: DataFrame, key: str = "age") -> DataFrame:
    """A sparse step table as one row per whole number up to its last step.

    Each step covers the numbers up to the next one, so an as-of lookup becomes an equality
    join; the last step holds for all greater numbers as well.
    """
    from pyspark.sql import Window

    # A step table has a few dozen rows; its order needs one task.
    follow = F.lead(key).over(Window.orderBy(key))
    return (steps.withColumn("_to", F.coalesce(follow - 1, key))
            .select(F.explode(F.sequence(key, "_to")).alias(key), "factor"))


def join_step_factor(df: DataFrame, steps: DataFrame, age: str, name: str,
                     key: str = "age", default: float = 1.0) -> DataFrame:
    """Factor of the greatest step at or below the age, by one equality join.

    Ages beyond the last step are looked up as that step; null ages and ages below the first step
    get the default.
    """
    dense = dense_steps(steps, key)
    last = dense.agg(F.max(key)).scalar()
    inside = dense.select(F.col(key).alias("_step"), F.col("factor").alias("_factor"))
    # least() passes over nulls, so a missing age has to stay missing by itself.
    step = F.when(F.col(age).isNotNull(), F.least(F.col(age), last))
    return (df.withColumn("_step", step).join(inside, "_step", "left")
            .withColumn(name, F.coalesce("_factor", F.lit(default))).drop("_step", "_factor"))
