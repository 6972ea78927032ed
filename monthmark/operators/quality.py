"""Data-quality checks and profiles as tidy tables.

Counts that need no distinct keys are fused into one aggregate over the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.functions.columns import free_name, percent
from monthmark.functions.skew import in_tasks
from monthmark.operators import aggregates as agg
from monthmark.sources.staging import stored

# The columns the checks look at.
KEY_COLUMNS = ["policy", "vehicle_no", "driver_no", "premium_paid"]
PROFILE_NUMERIC = ["premium_paid", "driver_age", "client_tenure_days", "model_year"]
PROFILE_CATEGORICAL = ["vehicle_type", "driver_type", "assignment_type"]

#: Hashes of more than one row at most that are sent to all tasks.
MOST_SHARED = 1_000_000


def consistency_rules(as_of_year: int) -> dict[str, Column]:
    """Rules a row breaks when the expression holds (ages 16 to 100 are valid)."""
    c = F.col
    return {
        "negative_premiums": c("premium_paid") < 0,
        "invalid_ages": (c("driver_age") < 16) | (c("driver_age") > 100),
        "future_model_years": c("model_year") > as_of_year,
        "negative_tenure": c("client_tenure_days") < 0,
    }


def inconsistent_rows(df: DataFrame, as_of_year: int) -> DataFrame:
    """Rows breaking a rule, with one boolean per rule."""
    flags = {n: F.coalesce(e, F.lit(False)) for n, e in consistency_rules(as_of_year).items()}
    any_broken = None
    for n in flags:
        any_broken = F.col(n) if any_broken is None else any_broken | F.col(n)
    return df.withColumns(flags).where(any_broken)


def consistency(df: DataFrame, as_of_year: int) -> DataFrame:
    return df.agg(*[F.count_if(e).alias(n) for n, e in consistency_rules(as_of_year).items()])


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls per column: (column_name, null_count, null_percentage), from one pass."""
    columns = columns or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_count"))
                      for i, c in enumerate(columns)])
    return row.select("_n", F.explode(cells).alias("x")).select(
        "x.column_name", "x.null_count",
        percent(F.col("x.null_count"), F.col("_n")).alias("null_percentage"))


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, with their share.

    Equal rows have equal hashes: rows are dealt by their hash alone, and only those whose hash comes more than once
    are compared as wholes, as a hash may be shared by different rows. With more than `MOST_SHARED` such hashes
    all rows are.
    """
    total, mark = df.count(), free_name(df, "_hash")
    hashed = df.withColumn(mark, F.xxhash64(*df.columns))
    counts = in_tasks(hashed.select(mark), [mark], total).groupBy(mark).agg(F.count(F.lit(1)).alias("n"))
    shared = stored(counts.where(F.col("n") > 1), "shared_hashes")
    held = shared.agg(F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    suspects, n = df, total
    if held["hashes"] <= MOST_SHARED:
        suspects, n = hashed.join(F.broadcast(shared.select(mark)), mark, "left_semi").drop(mark), held["rows"]
    # Whole rows are wide, so as many tasks compare them as there are rows for.
    groups = in_tasks(suspects, df.columns, n).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    whole = F.lit(total).cast("long")
    extra = F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))
    return groups.agg(whole.alias("total_records"), extra.alias("duplicate_records"),
                      percent(extra, whole).alias("duplicate_percentage"))


def _tidy(row: DataFrame, section: str, names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"),
                               F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def _scan_tidy(df: DataFrame, null_columns: list[str], as_of_year: int | None,
               described: list[str], date_span: bool = False) -> DataFrame:
    """(section, metric, key, value) rows of totals, nulls, rules and descriptions.

    Everything that needs no distinct keys comes out of this one aggregate over the panel.
    """
    aggs: list[Column] = []
    cells: list[tuple[str, str, str | None, str]] = []

    def add(section: str, metric: str, key: str | None, expr: Column) -> None:
        name = f"_{len(aggs)}"
        aggs.append(expr.alias(name))
        cells.append((section, metric, key, name))

    add("totals", "total_records", None, F.count(F.lit(1)))
    for c in null_columns:
        add("nulls", f"{c}_nulls", None, F.count_if(F.col(c).isNull()))
    if as_of_year is not None:
        for n, e in consistency_rules(as_of_year).items():
            add("consistency", n, None, F.count_if(e))
    for c in described:
        mean = agg.money_mean(c) if c.startswith("premium") else F.avg(c)
        for m, e in (("count", F.count(c)), ("mean", mean), ("stddev", F.stddev(c)),
                     ("min", F.min(c)), ("max", F.max(c))):
            add("columns", m, c, e)
    if date_span:
        for c, n in (("inforce_yy", "year"), ("inforce_mm", "month")):
            add("range", f"min_{n}", None, F.min(c))
            add("range", f"max_{n}", None, F.max(c))
    structs = [F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        F.lit(key).cast("string").alias("key"),
                        F.col(name).cast("double").alias("value"))
               for section, metric, key, name in cells]
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def _uniques(df: DataFrame) -> DataFrame:
    return _tidy(df.agg(*agg.unique_counts()), "totals",
                 ["unique_policies", "unique_vehicles", "unique_drivers"])


def _duplicates_tidy(df: DataFrame) -> DataFrame:
    return _tidy(duplicates(df), "duplicates", ["duplicate_records", "duplicate_percentage"])


def quality_report(df: DataFrame, as_of_year: int, columns: list[str] | None = None) -> DataFrame:
    """Totals, nulls, rule counts and duplicates: (section, metric, value)."""
    scan = _scan_tidy(df, columns or df.columns, as_of_year, []).drop("key")
    return scan.unionByName(_duplicates_tidy(df))


def validate_panel(df: DataFrame) -> DataFrame:
    """Totals, distinct keys, first and last period, nulls, premium description."""
    scan = _scan_tidy(df, KEY_COLUMNS, None, ["premium_paid"])
    metric = F.concat_ws("_", "key", "metric")  # a missing key is skipped
    scan = scan.select("section", metric.alias("metric"), "value")
    span = _tidy(agg.date_range(df), "range", ["first_period", "last_period"])
    return scan.unionByName(_uniques(df)).unionByName(span)


def _wide(df: DataFrame, section: str, key: Column, metrics: list[str]) -> DataFrame:
    """Rows of a report table as (section, metric, key, value) rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics])
    return df.select(F.lit(section).alias("section"), key.alias("key"),
                     F.explode(cells).alias("x")).select("section", "x.metric", "key", "x.value")


def profile_overview(df: DataFrame, as_of_year: int) -> DataFrame:
    """The five-section profile as tidy (section, metric, key, value) rows."""
    text = lambda c: F.col(c).cast("string")
    month = F.concat(text("inforce_yy"), F.lit("-"), F.lpad(text("inforce_mm"), 2, "0"))
    tops = agg.top_values(df, PROFILE_CATEGORICAL)
    median = agg.exact_median(df, ["premium_paid"])
    parts = [
        _scan_tidy(df, KEY_COLUMNS, as_of_year, PROFILE_NUMERIC, date_span=True),
        _uniques(df).unionByName(_duplicates_tidy(df)).withColumn(
            "key", F.lit(None).cast("string")),
        tops.select(F.lit("top_values").alias("section"), F.col("column_name").alias("metric"),
                    F.col("value").alias("key"), F.col("count").cast("double").alias("value")),
        _wide(agg.monthly_trends(df), "monthly", month,
              ["record_count", "unique_policies", "avg_premium"]),
        _wide(agg.temporal_report(df, ("inforce_yy",)), "yearly", text("inforce_yy"),
              ["record_count", "unique_policies", "unique_vehicles", "unique_drivers",
               "avg_premium", "total_premium"]),
        median.select(F.lit("columns").alias("section"), F.lit("median").alias("metric"),
                      F.col("column_name").alias("key"), F.col("median").alias("value")),
    ]
    for section, metrics in (("policy_metrics", agg.policy_metrics(df)),
                             ("vehicle_metrics", agg.vehicle_metrics(df))):
        parts.append(metrics.select(F.lit(section).alias("section"), "metric",
                                    F.col("column_name").alias("key"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", "metric", "key", "value")
