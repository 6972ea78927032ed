"""Reconciling stored and calculated premiums with the panel.

Both sides are one row per policy before they meet, so the outer join has no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.functions.columns import (basis_points, cents, half_up, percent, period)
from monthmark.params import Params


def latest_month(panel: DataFrame) -> DataFrame:
    """Rows of the latest month of each policy."""
    last = panel.groupBy("policy").agg(F.max(period()).alias("_last"))
    return panel.join(last, "policy").where(period() == F.col("_last")).drop("_last")


def inforce_latest(panel: DataFrame) -> DataFrame:
    """Per policy: mean and total premium, exposure and rows of its latest month.

    Rows are first added up per policy-month; the latest of those is then a maximum over a
    struct, so the panel is shuffled once. months_inforce counts calendar years with rows,
    as the compared reports do; months_observed counts the months.
    """
    monthly = panel.groupBy("policy", "inforce_yy", "inforce_mm").agg(
        F.sum(cents("premium_paid")).alias("c"), F.count("premium_paid").alias("n"),
        F.sum(basis_points("exposure_factor")).alias("e"), F.count(F.lit(1)).alias("r"))
    last = F.max(F.struct(period().alias("p"), "c", "n", "e", "r"))
    per = monthly.groupBy("policy").agg(
        last.alias("last"), F.count_distinct("inforce_yy").alias("months_inforce"),
        F.count(F.lit(1)).alias("months_observed"))
    return per.select(
        "policy", F.col("last.p").alias("latest_period"),
        (F.try_divide(F.col("last.c"), F.col("last.n")) / 100).alias("inforce_premium"),
        (F.col("last.c") / 100).alias("inforce_premium_total"),
        (F.col("last.e") / 10000).alias("current_exposure"),
        F.col("last.r").alias("records_in_latest_month"), "months_inforce", "months_observed")


def compare_sources(calculated: DataFrame, observed: DataFrame) -> DataFrame:
    """Full outer join per policy; a missing side counts as 0 and status 'unknown'."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    left = calculated.withColumnRenamed("policy_no", "policy")
    return left.join(observed, "policy", "full").select(
        "policy", F.coalesce("family_id", F.lit("N/A")).alias("family_id"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        zero("calculated_premium").alias("calculated_premium"),
        zero("stored_premium").alias("stored_premium"),
        zero("inforce_premium").alias("inforce_premium"),
        zero("total_exposure").alias("policy_exposure"),
        zero("current_exposure").alias("inforce_exposure"),
        F.coalesce("months_inforce", F.lit(0)).alias("months_inforce"))


def compare(calculated: DataFrame, observed: DataFrame, params: Params) -> DataFrame:
    """Differences per policy, flagged beyond the tolerance for active policies only.

    An observed amount of zero or less is not compared.
    """
    c = F.col
    both = compare_sources(calculated, observed).withColumns({
        "premium_diff": F.when(c("inforce_premium") > 0,
                               F.abs(c("calculated_premium") - c("inforce_premium"))).otherwise(0.0),
        "exposure_diff": F.when(c("inforce_exposure") > 0,
                                F.abs(c("policy_exposure") - c("inforce_exposure"))).otherwise(0.0),
        "stored_vs_calculated_diff": F.abs(c("stored_premium") - c("calculated_premium"))})
    active = c("status") == "active"
    beyond = lambda n: active & (c(n) > params.tolerance)
    return both.withColumns({
        "has_premium_discrepancy": beyond("premium_diff"),
        "has_exposure_discrepancy": beyond("exposure_diff"),
        "has_stored_discrepancy": beyond("stored_vs_calculated_diff")})


def _any_discrepancy() -> Column:
    return (F.col("has_premium_discrepancy") | F.col("has_exposure_discrepancy")
            | F.col("has_stored_discrepancy"))


def discrepancies(compared: DataFrame) -> DataFrame:
    return compared.where(_any_discrepancy())


def discrepancy_counts(compared: DataFrame) -> DataFrame:
    total, bad = F.count(F.lit(1)), F.count_if(_any_discrepancy())
    return compared.agg(
        total.alias("total_policies"), bad.alias("policies_with_discrepancies"),
        percent(bad, total).alias("discrepancy_rate"),
        F.count_if("has_premium_discrepancy").alias("premium_discrepancies"),
        F.count_if("has_exposure_discrepancy").alias("exposure_discrepancies"),
        F.count_if("has_stored_discrepancy").alias("stored_discrepancies"))


def top_discrepancies(compared: DataFrame, k: int = 10) -> DataFrame:
    """The k largest by premium plus exposure difference."""
    size = F.col("premium_diff") + F.col("exposure_diff")
    return (discrepancies(compared).withColumn("total_diff", size)
            .orderBy(F.desc("total_diff"), "policy").limit(k))


def compare_summary(compared: DataFrame) -> DataFrame:
    cols = ("calculated_premium", "stored_premium", "inforce_premium", "policy_exposure",
            "inforce_exposure")
    return compared.agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def annual_earned(panel: DataFrame) -> DataFrame:
    """Earned premium per policy and year: a twelfth of each month's annual premium."""
    return panel.groupBy("policy", "inforce_yy").agg(
        half_up(F.sum(cents("premium_paid")) / 12 / 100).alias("annual_earned"))


def assignment_annual(policies: DataFrame, assignments: DataFrame, year: int,
                      mode: str = "effective") -> DataFrame:
    """Annual premium of a policy's active assignments for a year.

    'effective' takes those effective by the end of the year; 'overlap' also needs the
    assignment to reach into the year.
    """
    begin, end = f"{year}-01-01", f"{year}-12-31"
    live = assignments.where((F.col("status") == "active")
                             & (F.col("effective_date") <= F.lit(end).cast("date")))
    if mode == "overlap":
        live = live.where(F.col("end_date").isNull()
                          | (F.col("end_date") > F.lit(begin).cast("date")))
    elif mode != "effective":
        raise ValueError(f"unknown mode: {mode}")
    per = live.groupBy("family_id").agg(
        (F.sum(cents("annual_premium_paid")) / 100).alias("_paid"))
    return policies.join(per, "family_id", "left").select(
        F.col("policy_no").alias("policy"), F.coalesce("_paid", F.lit(0.0)).alias("annual_premium"))


def reconcile_year(panel: DataFrame, policies: DataFrame, assignments: DataFrame,
                   year: int, mode: str = "effective") -> DataFrame:
    """Totals, differences and match counts of a year over the policies with rows in it."""
    earned = annual_earned(panel.where(F.col("inforce_yy") == year)).drop("inforce_yy")
    stored = assignment_annual(policies, assignments, year, mode)
    both = earned.join(stored, "policy", "left").withColumn(
        "annual_premium", F.coalesce("annual_premium", F.lit(0.0)))
    e, a = F.col("annual_earned"), F.col("annual_premium")
    pct = F.when(a > 0, F.abs((e - a) / a * 100))
    total = both.withColumn("_pct", pct).agg(
        F.count(F.lit(1)).alias("total_policies"),
        (F.sum(cents(e)) / 100).alias("total_inforce_premium"),
        (F.sum(cents(a)) / 100).alias("total_assignment_premium"),
        F.count_if(F.col("_pct") == 0).alias("perfect_matches"),
        F.count_if(F.col("_pct") <= 1).alias("within_1pct"),
        F.count_if(F.col("_pct") <= 5).alias("within_5pct"))
    diff = F.col("total_assignment_premium") - F.col("total_inforce_premium")
    out = total.withColumn("total_difference", half_up(diff)).withColumn(
        "aggregate_pct_difference",
        F.when(F.col("total_inforce_premium") > 0,
               F.col("total_difference") / F.col("total_inforce_premium") * 100).otherwise(0.0))
    out = out.withColumn("match_rate_1pct", percent(F.col("within_1pct"), F.col("total_policies")))
    return out.withColumn("success", F.abs("aggregate_pct_difference") <= 1.0)


def verdict(pct: str | Column = "aggregate_pct_difference") -> Column:
    """perfect within 0.01 %, within_tolerance within 1 %, else outside_tolerance."""
    size = F.abs(pct)
    return F.when(size <= 0.01, "perfect").when(size <= 1.0, "within_tolerance").otherwise(
        "outside_tolerance")


def policy_verdicts(panel: DataFrame, policies: DataFrame, assignments: DataFrame,
                    year: int) -> DataFrame:
    """Difference and verdict per policy of a year (null for no stored premium)."""
    earned = annual_earned(panel.where(F.col("inforce_yy") == year)).drop("inforce_yy")
    both = earned.join(assignment_annual(policies, assignments, year), "policy", "left")
    e, a = F.col("annual_earned"), F.coalesce("annual_premium", F.lit(0.0))
    pct = F.when(a > 0, (e - a) / a * 100)
    return both.select("policy", "annual_earned", a.alias("annual_premium"),
                       pct.alias("pct_difference"),
                       F.when(pct.isNotNull(), verdict(pct)).alias("verdict"))
