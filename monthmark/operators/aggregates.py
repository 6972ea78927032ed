"""Single- and two-level aggregations over the panel.

Distinct counts are shuffled on (group, key), never on the group alone, so a group holding
most of the rows is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.functions.columns import (as_col, composite, money_mean, money_sum, percent,
                                         period, rounded_ratio)
from monthmark.functions.ranking import exact_median

MONTH = ["inforce_yy", "inforce_mm"]


def rows(alias: str = "record_count") -> Column:
    return F.count(F.lit(1)).alias(alias)


def _grouped(df: DataFrame, by: list, *measures: Column) -> DataFrame:
    return df.groupBy(*by).agg(*measures) if by else df.agg(*measures)


def unique_counts(scope: str = "raw") -> list[Column]:
    return [
        F.count_distinct("policy").alias("unique_policies"),
        F.count_distinct(composite(scope, "vehicle_no")).alias("unique_vehicles"),
        F.count_distinct(composite(scope, "driver_no")).alias("unique_drivers"),
    ]


# --- statistics -----------------------------------------------------------------------

def basic_stats(df: DataFrame, columns: list[str], money: tuple[str, ...] = ()) -> DataFrame:
    """Mean, min, max and sample deviation of each column, in one row."""
    out = []
    for c in columns:
        mean = money_mean(c) if c in money else F.avg(c)
        out += [mean.alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                F.stddev(c).alias(f"{c}_stddev")]
    return df.agg(*out)


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (column_name, value) rows, values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of all columns from one scan: (column_name, value, count)."""
    return _values(df, columns).groupBy("column_name", "value").agg(rows("count"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column, with the number of distinct values."""
    counts = categorical_summary(df, columns)
    # Naming the count keeps it in both branches, which then share one scan and shuffle.
    uniques = counts.groupBy("column_name").agg(
        F.count_if(F.col("count") > 0).alias("unique_count"))
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    # Spark keeps only k rows per task before the shuffle of this ranking.
    return (counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(uniques, "column_name"))


def premium_analysis(df: DataFrame, premium: str = "premium_paid", by: tuple = ()) -> DataFrame:
    return _grouped(
        df, list(by), rows(), F.count_distinct("policy").alias("unique_policies"),
        money_mean(premium).alias("avg_premium"), F.min(premium).alias("min_premium"),
        F.max(premium).alias("max_premium"), F.stddev(premium).alias("premium_stddev"),
        money_sum(premium).alias("total_premium"))


def age_analysis(df: DataFrame, age: str = "driver_age", by: tuple = ()) -> DataFrame:
    return _grouped(df, list(by), rows(), F.avg(age).alias("avg_age"), F.min(age).alias("min_age"),
                    F.max(age).alias("max_age"), F.stddev(age).alias("age_stddev"))


def with_vehicle_age(df: DataFrame, as_of_year: int, model_year: str = "model_year") -> DataFrame:
    return df.withColumn("vehicle_age", F.lit(as_of_year) - F.col(model_year))


def vehicle_analysis(df: DataFrame, by: str) -> DataFrame:
    """Rows, policies and mean premium per vehicle type, model year or vehicle age."""
    return df.groupBy(by).agg(rows("count"), F.count_distinct("policy").alias("unique_policies"),
                              money_mean("premium_paid").alias("avg_premium"))


def temporal_report(df: DataFrame, by: tuple = tuple(MONTH), scope: str = "raw") -> DataFrame:
    """Rows, distinct policies / vehicles / drivers and premium per period."""
    return df.groupBy(*by).agg(rows(), *unique_counts(scope),
                               money_mean("premium_paid").alias("avg_premium"),
                               money_sum("premium_paid").alias("total_premium"))


def monthly_inforce(df: DataFrame) -> DataFrame:
    return df.groupBy(*MONTH).agg(F.count_distinct("policy").alias("inforce_policies"),
                                  money_mean("premium_paid").alias("avg_premium"),
                                  F.avg("driver_age").alias("avg_driver_age"))


def monthly_trends(df: DataFrame) -> DataFrame:
    return df.groupBy(*MONTH).agg(rows(), F.count_distinct("policy").alias("unique_policies"),
                                  money_mean("premium_paid").alias("avg_premium"))


def type_profile(df: DataFrame, by: str, with_age: bool = False) -> DataFrame:
    extra = [F.avg("driver_age").alias("avg_age")] if with_age else []
    return df.groupBy(by).agg(rows(), F.count_distinct("policy").alias("unique_policies"),
                              money_mean("premium_paid").alias("avg_premium"), *extra)


def premium_by_driver_type(df: DataFrame) -> DataFrame:
    return df.groupBy("driver_type").agg(money_mean("premium_paid").alias("avg_premium"))


def value_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(rows("count"))


def top_types(df: DataFrame, k: int = 5) -> DataFrame:
    return value_counts(df, "vehicle_type").orderBy(F.desc("count"), "vehicle_type").limit(k)


def top_expiry_dates(df: DataFrame, k: int = 10) -> DataFrame:
    return (value_counts(df, "policy_expiry_date")
            .orderBy(F.desc("count"), "policy_expiry_date").limit(k))


def model_year_mode(df: DataFrame) -> DataFrame:
    """First, last and most common model year; the earliest year wins a tie."""
    best = F.max(F.struct("count", (-F.col("model_year")).alias("neg"))).alias("best")
    return (df.where(F.col("model_year").isNotNull()).groupBy("model_year").agg(rows("count"))
            .agg(F.min("model_year").alias("min_year"), F.max("model_year").alias("max_year"), best)
            .select("min_year", "max_year", (-F.col("best.neg")).alias("most_common_year"),
                    F.col("best.count").alias("most_common_count")))


def per_policy_count(df: DataFrame, key: str, alias: str) -> DataFrame:
    """Mean and maximum of the distinct keys per policy."""
    counts = df.groupBy("policy").agg(F.count_distinct(key).alias("n"))
    return counts.agg(F.avg("n").alias(f"mean_{alias}"), F.max("n").alias(f"max_{alias}"))


def rows_span(df: DataFrame, by: str, with_span: bool = True) -> DataFrame:
    """Smallest and largest row count per value of `by`, and the values' span."""
    counts = df.groupBy(by).agg(rows("n"))
    span = [F.min(by).alias("min_value"), F.max(by).alias("max_value")] if with_span else []
    return counts.agg(*span, F.min("n").alias("min_count"), F.max("n").alias("max_count"))


def distinct_cardinality(df: DataFrame, scope: str = "raw",
                         approximate: float | None = None) -> DataFrame:
    """Distinct policies, vehicles, drivers and driver names, in one row.

    With `approximate` (a relative error) the counts come from sketches in a single pass.
    """
    keys = {"unique_policies": F.col("policy"),
            "unique_vehicles": composite(scope, "vehicle_no"),
            "unique_drivers": composite(scope, "driver_no"),
            "unique_driver_names": F.col("driver_name")}
    if approximate is not None:
        return df.agg(*[F.approx_count_distinct(c, approximate).alias(a) for a, c in keys.items()])
    return df.agg(*[F.count_distinct(c).alias(a) for a, c in keys.items()])


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min(period()).alias("first_period"), F.max(period()).alias("last_period"))


def date_stats(df: DataFrame) -> DataFrame:
    """Extremes of year and month taken independently of each other."""
    return df.agg(F.min("inforce_yy").alias("min_year"), F.max("inforce_yy").alias("max_year"),
                  F.min("inforce_mm").alias("min_month"), F.max("inforce_mm").alias("max_month"))


# --- descriptions -----------------------------------------------------------------------

def _long(row: DataFrame, cells: list[tuple[str, str, str]]) -> DataFrame:
    """One aggregated row as (column_name, metric, value) rows."""
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric"),
                        F.col(n).cast("double").alias("value")) for c, m, n in cells]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def describe_numeric(df: DataFrame, columns: list[str], money: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, stddev, min and max per column as tidy rows, from one aggregate."""
    aggs, cells = [], []
    for c in columns:
        mean = money_mean(c) if c in money else F.avg(c)
        for metric, expr in (("count", F.count(c)), ("mean", mean), ("stddev", F.stddev(c)),
                             ("min", F.min(c)), ("max", F.max(c))):
            name = f"{c}__{metric}"
            aggs.append(expr.alias(name))
            cells.append((c, metric, name))
    return _long(df.agg(*aggs), cells)


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, min and max of text columns as (column_name, metric, text) rows."""
    aggs, structs = [], []
    for c in columns:
        for metric, expr in (("count", F.count(c)), ("min", F.min(c)), ("max", F.max(c))):
            name = f"{c}__{metric}"
            aggs.append(expr.cast("string").alias(name))
            structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(metric).alias("metric"),
                                    F.col(name).alias("text")))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def data_summary(df: DataFrame) -> DataFrame:
    """Description of the summary columns: numbers in `value`, texts in `text`."""
    numbers = describe_numeric(df, ["inforce_yy", "inforce_mm", "premium_paid", "driver_age"],
                               money=("premium_paid",))
    texts = describe_text(df, ["policy", "vehicle_type", "driver_type"])
    return numbers.unionByName(texts, allowMissingColumns=True)


def stats_with_median(df: DataFrame, column: str, money: bool = False) -> DataFrame:
    """describe_numeric plus the exact median."""
    middle = exact_median(df, [column]).select(
        "column_name", F.lit("median").alias("metric"), F.col("median").alias("value"))
    return describe_numeric(df, [column], (column,) if money else ()).unionByName(middle)


def policy_metrics(df: DataFrame) -> DataFrame:
    """Per-policy row, vehicle and driver counts and mean premium, then described."""
    per = df.groupBy("policy").agg(
        rows(), F.count_distinct("vehicle_no").alias("vehicle_count"),
        F.count_distinct("driver_no").alias("driver_count"),
        money_mean("premium_paid").alias("avg_premium"))
    return describe_numeric(per, ["record_count", "vehicle_count", "driver_count", "avg_premium"])


def vehicle_metrics(df: DataFrame, scope: str = "raw") -> DataFrame:
    """Per-vehicle row and driver counts and mean premium, then described."""
    per = df.groupBy(composite(scope, "vehicle_no").alias("vehicle")).agg(
        rows(), F.count_distinct("driver_no").alias("driver_count"),
        money_mean("premium_paid").alias("avg_premium"))
    return describe_numeric(per, ["record_count", "driver_count", "avg_premium"])


# --- distributions over time ------------------------------------------------------------

def type_share(df: DataFrame) -> DataFrame:
    """Share of each vehicle type in a month's rows, in percent."""
    month = Window.partitionBy(*MONTH)
    return (df.groupBy(*MONTH, "vehicle_type").agg(rows("count"))
            .withColumn("total_vehicles", F.sum("count").over(month))
            .withColumn("vehicle_type_pct", percent(F.col("count"), F.col("total_vehicles"))))


def type_share_pivot(df: DataFrame, types: list[str], first_row_only: bool = False,
                     scale: int | None = None) -> DataFrame:
    """One column vehicle_type_<T>_pct per known type, 0 where a type is absent.

    With `first_row_only` the base is one row per policy-month instead of all rows.
    """
    base = df
    if first_row_only:
        base = first_rows(df, ["vehicle_type"])
    counts = [F.count_if(F.col("vehicle_type") == t).alias(f"_t{i}") for i, t in enumerate(types)]
    agg = base.groupBy(*MONTH).agg(F.count("vehicle_type").alias("_n"), *counts)
    shares = []
    for i, t in enumerate(types):
        share = F.coalesce(percent(F.col(f"_t{i}"), F.col("_n")), F.lit(0.0))
        if scale is not None:
            share = F.coalesce(rounded_ratio(F.col(f"_t{i}") * 100, F.col("_n"), scale)
                               .cast("double"), F.lit(0.0))
        shares.append(share.alias(f"vehicle_type_{t}_pct"))
    return agg.select(*MONTH, *shares)


def first_rows(df: DataFrame, columns: list[str],
               order: tuple[str, ...] = ("vehicle_no", "driver_no")) -> DataFrame:
    """First non-null value of each column per policy-month, in the given row order.

    An aggregate rather than a window: partial results are combined before the shuffle.
    """
    picks = []
    for c in columns:
        rank = F.struct(*[F.col(o) for o in order], F.col(c).alias("_tie"))
        picks.append(F.min(F.when(F.col(c).isNotNull(), F.struct(rank.alias("r"),
                                                                 F.col(c).alias("v"))))["v"].alias(c))
    return df.groupBy("policy", *MONTH).agg(*picks)


def _first_with_flag(df: DataFrame, changed: DataFrame | None) -> DataFrame:
    """First values per policy-month with its flag, which is the same on all its rows.

    `changed` holds the policy-months with a change; without it the panel's own column is used.
    """
    if changed is None:
        flag = ["major_change"] if "major_change" in df.columns else []
        return first_rows(df, ["premium_paid", "driver_age", *flag])
    keys = ["policy", *MONTH]
    marks = changed.select(*keys, F.lit(True).alias("major_change"))
    return first_rows(df, ["premium_paid", "driver_age"]).join(marks, keys, "left").withColumn(
        "major_change", F.coalesce("major_change", F.lit(False)))


def monthly_unique_policy(df: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Monthly figures over one row per policy-month, with change counts when flagged."""
    base = _first_with_flag(df, changed)
    out = [rows("inforce_count"), money_mean("premium_paid").alias("avg_premium"),
           F.avg("driver_age").alias("avg_driver_age")]
    if "major_change" in base.columns:
        count = F.count_if("major_change")
        out += [count.alias("major_change_count"),
                F.try_divide(count, F.count("major_change")).alias("major_change_rate")]
    return base.groupBy(*MONTH).agg(*out)


def monthly_change_split(df: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Mean premium and age of policies with and without a change in the month."""
    base = _first_with_flag(df, changed)
    out = []
    for flag, suffix in ((True, "with_changes"), (False, "without_changes")):
        mine = F.col("major_change") == flag
        out += [money_mean(F.when(mine, F.col("premium_paid"))).alias(f"avg_premium_{suffix}"),
                F.avg(F.when(mine, F.col("driver_age"))).alias(f"avg_driver_age_{suffix}")]
    return base.groupBy(*MONTH).agg(*out)


def premium_levels(df: DataFrame) -> DataFrame:
    """Distinct premiums per policy; a single one is static."""
    return (df.groupBy("policy").agg(F.count_distinct("premium_paid").alias("distinct_premiums"))
            .withColumn("is_static", F.col("distinct_premiums") == 1))


def before_after(df: DataFrame, split_period: int, year: int | None = None) -> DataFrame:
    """Did the set of vehicle types or rates of a policy change at a period?

    Two sets are equal when every value occurs on both sides, so values are counted per
    (policy, value) instead of being collected.
    """
    p = period()
    src = df if year is None else df.where(F.col("inforce_yy") == year)
    sides = [F.max((p < split_period).cast("int")).alias("b"),
             F.max((p >= split_period).cast("int")).alias("a")]

    values = F.array(
        F.struct(F.lit("type").alias("kind"), F.col("vehicle_type").alias("value")),
        F.struct(F.lit("rate").alias("kind"), F.col("premium_rate").cast("string").alias("value")))
    seen = (src.select("policy", "inforce_yy", "inforce_mm", F.explode(values).alias("x"))
            .select("policy", "inforce_yy", "inforce_mm", "x.*")
            .groupBy("policy", "kind", "value").agg(*sides))
    kind = lambda k: F.col("kind") == k
    only_one = F.col("a") != F.col("b")
    return seen.groupBy("policy").agg(
        F.count_if(kind("type") & (F.col("b") == 1)).alias("types_before"),
        F.count_if(kind("type") & (F.col("a") == 1)).alias("types_after"),
        F.count_if(kind("rate") & (F.col("b") == 1)).alias("rates_before"),
        F.count_if(kind("rate") & (F.col("a") == 1)).alias("rates_after"),
        (F.count_if(kind("type") & only_one) > 0).alias("type_changed"),
        (F.count_if(kind("rate") & only_one) > 0).alias("rate_changed"))


def assignment_stats(assignments: DataFrame) -> DataFrame:
    """Assignment counts by status and the spread of stored rates and premiums."""
    status = as_col("status")
    out = [rows("total"), F.count_if(status == "active").alias("active"),
           F.count_if(status == "removed").alias("removed")]
    for c, name in (("annual_premium_rate", "rate"), ("annual_premium_paid", "paid")):
        out += [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"),
                money_mean(c).alias(f"mean_{name}")]
    return assignments.agg(*out)


def policy_month_breakdown(df: DataFrame) -> DataFrame:
    """Rate x exposure = paid lines of each policy-month, with the month's total."""
    keys = ["policy", *MONTH]
    total = df.groupBy(*keys).agg(money_sum("premium_paid").alias("total_premium"))
    return df.join(total, keys).select(
        *keys, "driver_name", "vehicle_no", "premium_rate", "exposure_factor", "premium_paid",
        "total_premium")


def round_columns(df: DataFrame, names: list[str], scale: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, scale) for n in names})
