"""Filters, distinct sets and month-to-month lookups over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmark.functions.columns import period
from monthmark.functions.ranking import range_rank
from monthmark.functions.skew import in_tasks
from monthmark.operators.aggregates import MONTH

KEYS = ["policy", *MONTH]
ROW_ORDER = [*MONTH, "vehicle_no", "driver_no"]


def in_period_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with first <= yyyymm <= last.

    Written on year and month themselves, so partitions of a month-partitioned panel are
    pruned before any file is opened.
    """
    y0, m0, y1, m1 = first // 100, first % 100, last // 100, last % 100
    y, m = F.col("inforce_yy"), F.col("inforce_mm")
    return df.where((y >= y0) & (y <= y1) & ((y > y0) | (m >= m0)) & ((y < y1) | (m <= m1)))


def policy_month(df: DataFrame, policy: str, year: int, month: int) -> DataFrame:
    return df.where((F.col("policy") == policy) & (F.col("inforce_yy") == year)
                    & (F.col("inforce_mm") == month))


def policy_timeline(df: DataFrame) -> DataFrame:
    """Rows of each policy in order of month, vehicle and driver, with their 0-based position.

    Ranked by a sample sort, so neither a policy nor one of its months has to fit a task.
    """
    return range_rank(df.select("policy", *ROW_ORDER), ["policy"], ROW_ORDER, "position")


def month_pair(df: DataFrame, year: int, month: int, policy: str | None = None) -> DataFrame:
    """Rows of a month and of the calendar month before it (December before January)."""
    index = year * 12 + month - 1
    pairs = [divmod(i, 12) for i in (index - 1, index)]
    hit = None
    for y, m in pairs:
        one = (F.col("inforce_yy") == y) & (F.col("inforce_mm") == m + 1)
        hit = one if hit is None else hit | one
    out = df.where(hit)
    return out if policy is None else out.where(F.col("policy") == policy)


def exposure_anomalies(df: DataFrame) -> DataFrame:
    """Primary rows whose exposure does not fit the number of drivers of the policy-month.

    With one driver it must be 1, with several it must not. Drivers are distinct by number,
    name, age and type.
    """
    people = df.select(*KEYS, "driver_no", "driver_name", "driver_age", "driver_type")
    people = in_tasks(people, people.columns, df.count()).distinct()
    counts = people.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("drivers"))
    full = F.col("exposure_factor") == 1.0
    primaries = df.where(F.col("assignment_type") == "primary")
    return primaries.join(counts, KEYS).where(
        (~full & (F.col("drivers") == 1)) | (full & (F.col("drivers") > 1)))


def distinct_policies(df: DataFrame) -> DataFrame:
    return df.select("policy").distinct()


def distinct_periods(df: DataFrame) -> DataFrame:
    return df.select(*MONTH).distinct()


def month_drivers(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "driver_no", "driver_name", "driver_age").distinct()


def month_vehicles(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "vehicle_no", "vehicle_type", "model_year").distinct()


def union_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys found in either table."""
    return (left.select(F.col(left_key).alias("policy"))
            .union(right.select(F.col(right_key).alias("policy")))
            .where(F.col("policy").isNotNull()).distinct())


def policy_assignments(policies: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments with the policy of their family."""
    return assignments.join(policies.select("family_id", "policy_no"), "family_id")


def with_period_parts(df: DataFrame) -> DataFrame:
    """yyyymm and its year and month again."""
    from monthmark.functions.columns import period_month, period_year

    return df.withColumn("period", period()).withColumns(
        {"period_year": period_year("period"), "period_month": period_month("period")})


def first_in_active(df: DataFrame, independent: bool = True) -> DataFrame:
    """Policies that have rows in the month given as their first one."""
    from monthmark.operators.lifecycle import first_periods

    months = df.select("policy", period().alias("first_period")).distinct()
    return first_periods(df, independent).join(months, ["policy", "first_period"], "left_semi")
