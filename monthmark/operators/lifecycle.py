"""Retention, cohorts, new and renewed policies, and the monthly distribution report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthmark.functions.columns import (cents, index_month, index_year, month_index, period,
                                         period_month, period_year, rounded_ratio)
from monthmark.functions.skew import in_tasks
from monthmark.operators.aggregates import MONTH


def _by_period():
    """Order of a month table; its single task is bounded by the number of months."""
    return Window.orderBy("period")


def retention(df: DataFrame) -> DataFrame:
    """Policies per month over those of the month before; 1.0 for the first month."""
    per = df.select(period().alias("period"), "policy").groupBy("period").agg(
        F.count_distinct("policy").alias("unique_policies"))
    prev = F.lag("unique_policies").over(_by_period())
    rate = F.when(prev.isNull(), F.lit(1.0)).otherwise(F.try_divide(F.col("unique_policies"), prev))
    return per.select(period_year("period").alias("period_year"),
                      period_month("period").alias("period_month"),
                      "unique_policies", rate.alias("retention_rate"))


def retention_true(df: DataFrame) -> DataFrame:
    """Policies present in two consecutive calendar months over those of the first.

    Each row is emitted at its own month and at the next; a policy kept has both. The copies
    are combined per (policy, month) before the one shuffle.
    """
    one = lambda m, here, was: F.struct(m.alias("m"), F.lit(here).alias("here"),
                                        F.lit(was).alias("was"))
    copies = F.array(one(month_index(), 1, 0), one(month_index() + 1, 0, 1))
    both = (df.where(F.col("policy").isNotNull()).select("policy", F.explode(copies).alias("x"))
            .select("policy", "x.*")
            .groupBy("policy", "m").agg(F.max("here").alias("here"), F.max("was").alias("was")))
    per = both.groupBy("m").agg(
        F.sum("here").alias("unique_policies"),
        F.sum("was").alias("previous_policies"),
        F.sum(F.col("here") * F.col("was")).alias("retained_policies"))
    return per.where(F.col("unique_policies") > 0).select(
        index_year("m").alias("period_year"), index_month("m").alias("period_month"),
        "unique_policies", "previous_policies", "retained_policies",
        F.try_divide(F.col("retained_policies"), F.col("previous_policies"))
        .alias("retention_rate"))


def cohorts(df: DataFrame, date_column: str = "policy_expiry_date") -> DataFrame:
    """Policies per year-month of their earliest date."""
    first = df.where(F.col("policy").isNotNull()).groupBy("policy").agg(
        F.min(date_column).alias("d"))
    return first.groupBy(period(F.year("d"), F.month("d")).alias("cohort_period")).agg(
        F.count(F.lit(1)).alias("cohort_size"))


def first_periods(df: DataFrame, independent: bool = False) -> DataFrame:
    """First month of each policy.

    `independent` takes the smallest year and the smallest month separately, which is only
    of use to compare with tables made that way.
    """
    if independent:
        first = period(F.min("inforce_yy"), F.min("inforce_mm"))
    else:
        first = F.min(period())
    return df.groupBy("policy").agg(first.alias("first_period"))


def new_renewed(df: DataFrame) -> DataFrame:
    """Per month: policies in force, new (first month) and renewed (seen before)."""
    pm = df.select("policy", period().alias("period")).distinct()
    inforce = pm.groupBy("period").agg(F.count("policy").alias("inforce_count"))
    new = first_periods(df).groupBy(F.col("first_period").alias("period")).agg(
        F.count("policy").alias("new_policies"))
    # Both sides have one row per month.
    return inforce.join(new, "period", "left").select(
        "period", "inforce_count",
        F.coalesce("new_policies", F.lit(0)).alias("new_policies"),
        (F.col("inforce_count") - F.coalesce("new_policies", F.lit(0))).alias("renewed_policies"))


def cumulative_policies(df: DataFrame) -> DataFrame:
    """Policies ever seen up to and including each month."""
    return new_renewed(df).select(
        "period",
        F.sum("new_policies").over(_by_period().rowsBetween(Window.unboundedPreceding, 0))
        .alias("cumulative_policy_count"))


def policy_month_rollup(df: DataFrame) -> DataFrame:
    """One row per policy-month with everything the monthly report needs.

    Every row becomes a driver item, which carries the measures, and a vehicle item. Items are dealt by all of their
    key over as many tasks as there are rows for, combined there and counted, so no policy or month is a hot group.
    """
    flag = ["major_change"] if "major_change" in df.columns else []
    one = F.lit(1).cast("long")
    measures = {"n": one, "premium_cents": cents("premium_paid"),
                "premium_n": F.col("premium_paid").isNotNull().cast("long"),
                "age_sum": F.col("driver_age").cast("long"), "age_n": F.col("driver_age").isNotNull().cast("long")}
    text = lambda c: F.col(c).cast("string").alias("key")
    driver = F.struct(F.lit(True).alias("of_driver"), text("driver_no"), *[v.alias(k) for k, v in measures.items()],
                      *flag)
    empty = [F.lit(None).cast("long").alias(k) for k in measures]
    vehicle = F.struct(F.lit(False).alias("of_driver"), text("vehicle_no"), *empty,
                       *[F.lit(None).cast("boolean").alias(c) for c in flag])
    keys = ["policy", *MONTH]
    add = [F.sum(c).alias(c) for c in measures] + [F.max(c).alias(c) for c in flag]
    items = df.select(*keys, F.explode(F.array(driver, vehicle)).alias("i")).select(*keys, "i.*")
    items = in_tasks(items, [*keys, "of_driver", "key"], 2 * df.count()).groupBy(*keys, "of_driver", "key").agg(*add)
    known = F.col("key").isNotNull()
    return items.groupBy(*keys).agg(*add, F.count_if(F.col("of_driver") & known).alias("driver_count"),
                                    F.count_if(~F.col("of_driver") & known).alias("vehicle_count"))


def monthly_distribution(df: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """The monthly report, rounded: one row per month.

    `changed` holds the policy-months with a change; with it (or with a major_change column
    in the panel) the change counts are added, by rows and by policies. It is joined at
    policy-month grain, so the panel itself is never shuffled for the flags. First months come from the
    policy-months as well: the panel is read once, besides what `changed` reads.
    """
    # A policy's policy-months are no more than the calendar has months.
    first = F.min(period()).over(Window.partitionBy("policy"))
    rollup = policy_month_rollup(df).withColumn("is_new", F.col("policy").isNotNull() & (period() == first))
    if changed is not None:
        marks = changed.select("policy", *MONTH, F.lit(True).alias("major_change"))
        rollup = rollup.join(marks, ["policy", *MONTH], "left")
    flagged = "major_change" in rollup.columns
    sums = [F.count("policy").alias("inforce_count"), F.sum("n").alias("n"),
            F.sum("premium_cents").alias("premium_cents"), F.sum("premium_n").alias("premium_n"),
            F.sum("age_sum").alias("age_sum"), F.sum("age_n").alias("age_n"),
            F.count(F.lit(1)).alias("groups"), F.sum("driver_count").alias("drivers"),
            F.sum("vehicle_count").alias("vehicles"), F.count_if("is_new").alias("new_policies")]
    if flagged:
        changed_rows = F.sum(F.when(F.col("major_change"), F.col("n")))
        sums += [F.coalesce(changed_rows, F.lit(0)).alias("rows_changed"),
                 F.count_if("major_change").alias("policies_changed")]
    month = rollup.groupBy(*MONTH).agg(*sums).withColumn("period", period()).withColumn(
        "cumulative_policy_count",
        F.sum("new_policies").over(_by_period().rowsBetween(Window.unboundedPreceding, 0)))
    c = F.col
    out = [
        c("inforce_yy").alias("year"), c("inforce_mm").alias("month"),
        "inforce_count", "cumulative_policy_count", "new_policies",
        (c("inforce_count") - c("new_policies")).alias("renewed_policies"),
        (rounded_ratio(c("premium_cents"), c("premium_n"), 0) / 100)
        .cast("decimal(18,2)").alias("avg_premium"),
        rounded_ratio(c("age_sum"), c("age_n"), 1).cast("decimal(10,1)").alias("avg_driver_age"),
        rounded_ratio(c("drivers"), c("groups"), 2).cast("decimal(18,2)")
        .alias("avg_driver_count"),
        rounded_ratio(c("vehicles"), c("groups"), 2).cast("decimal(18,2)")
        .alias("avg_vehicle_count"),
    ]
    if flagged:
        out += [c("rows_changed").alias("major_change_rows"),
                rounded_ratio(c("rows_changed"), c("n"), 3).cast("decimal(5,3)")
                .alias("major_change_row_rate"),
                c("policies_changed").alias("major_change_policies"),
                rounded_ratio(c("policies_changed"), c("inforce_count"), 3).cast("decimal(5,3)")
                .alias("major_change_policy_rate")]
    return month.select(*out)


def monthly_averages(df: DataFrame) -> DataFrame:
    """Policies, mean premium and age, and mean drivers and vehicles per policy, by month."""
    r = policy_month_rollup(df)
    return r.groupBy(*MONTH).agg(
        F.count("policy").alias("inforce_count"),
        (F.try_divide(F.sum("premium_cents"), F.sum("premium_n")) / 100).alias("avg_premium"),
        F.try_divide(F.sum("age_sum"), F.sum("age_n")).alias("avg_driver_age"),
        F.avg("driver_count").alias("avg_driver_count"),
        F.avg("vehicle_count").alias("avg_vehicle_count"))


def monthly_with_shares(df: DataFrame, types: list[str]) -> DataFrame:
    """Monthly averages with the vehicle-type shares; both sides have one row per month."""
    from monthmark.operators.aggregates import type_share_pivot

    return monthly_averages(df).join(type_share_pivot(df, types), MONTH, "left")


def monthly_with_new(df: DataFrame) -> DataFrame:
    """Monthly averages with the policies first seen in the month, counted beforehand."""
    new = first_periods(df).groupBy("first_period").agg(F.count("policy").alias("new_policies"))
    stats = monthly_averages(df).withColumn("first_period", period())
    return stats.join(new, "first_period", "left").withColumn(
        "new_policies", F.coalesce("new_policies", F.lit(0))).drop("first_period")
