"""Ranks and medians that never gather a whole group into one task."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.functions.columns import as_col, free_name
from monthmark.sources.staging import stored

PREFIX = 6


def prefix_bucket(df: DataFrame, key: str, length: int = PREFIX) -> Column:
    """A prefix of the keys of df: buckets sort the same way as the whole strings.

    All keys share what the smallest and the largest have in common, so the prefix is `length`
    characters longer than that: keys such as POL-2024-000001 spread as well as bare numbers.
    """
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("z"))
    upto = F.sequence(F.lit(0), F.least(F.length("a"), F.length("z")))
    shared = F.array_max(F.filter(upto, lambda n: F.left("a", n) == F.left("z", n)))
    common = ends.select(F.coalesce(shared, F.lit(0)).alias("n")).scalar()
    return F.coalesce(F.left(F.col(key), common + length), F.lit(""))


def range_rank(df: DataFrame, group: list[str], order: list[str], rank: str,
               size: str | None = None) -> DataFrame:
    """0-based position of each row in its group along ascending `order`, with the group's size.

    A sample sort: rows are dealt over tasks by measured ranges of (group, order), sorted there and
    stored with their place in the task. A group that covers several tasks adds what its earlier
    tasks hold, from a table with one row for each task and group. No window holds rows of a group,
    whatever its keys look like. Nulls come first, and null groups are a group; rows equal in group
    and order are dealt over tasks as well and numbered in any order.
    """
    place, tie = free_name(df, "_place"), free_name(df, "_tie")
    keys = [F.col(c) for c in [*group, *order]]
    # Partition number and row number in it, taken behind the sort.
    dealt = (df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie)
             .sortWithinPartitions(*keys, tie).drop(tie).withColumn(place, F.monotonically_increasing_id()))
    rows = stored(dealt, "ranges")
    part, row = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    names = [f"_g{i}" for i in range(len(group))]
    runs = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)], part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    # One row for each task that holds rows of the group.
    runs = stored(runs, "runs")
    whole = Window.partitionBy(*names)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*names, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                          F.sum("_n").over(whole).alias("_size"))
    same = [F.col("_part") == part, *[F.col(n).eqNullSafe(F.col(g)) for g, n in zip(group, names)]]
    out = rows.join(offsets, functools.reduce(lambda a, b: a & b, same)).withColumn(rank, F.col("_shift") + row)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop(place, "_part", "_shift", "_size", *names)


def bucketed_rank(df: DataFrame, group: list[str], order: list[Column], bucket: Column,
                  rank: str, size: str | None = None) -> DataFrame:
    """0-based position of each row in its group, with the group size.

    `bucket` must never decrease along `order`. Rows are sorted per (group, bucket) only;
    the bucket counts, few per group, give each bucket its offset.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *group, "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_size"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    out = tagged.join(offsets, [*group, "_bucket"]).withColumn(
        rank, F.col("_offset") + F.row_number().over(inside) - 1)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_bucket", "_offset", "_size")


def bucketed_lead(df: DataFrame, key: str, out: str, length: int = PREFIX) -> DataFrame:
    """For each distinct key the next greater key, without one global sort.

    Inside a prefix bucket this is a window; the last key of a bucket takes the first key
    of the next bucket, from a table with one row per prefix.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    keys = keys.withColumn("_bucket", prefix_bucket(keys, key, length))
    # One row per prefix: this window's single task is bounded by the prefix alphabet.
    heads = keys.groupBy("_bucket").agg(F.min(key).alias("_head")).select(
        "_bucket", F.lead("_head").over(Window.orderBy("_bucket")).alias("_next_head"))
    inside = Window.partitionBy("_bucket").orderBy(key)
    return keys.join(heads, "_bucket").select(
        key, F.coalesce(F.lead(key).over(inside), F.col("_next_head")).alias(out))


# ln(1 + |v|) of any double is below 710, so the bucket table has a fixed upper size.
_LOG_BUCKETS = 512

#: Parts into which a bucket is divided that holds too many distinct values, and how many one task may well sort.
_PARTS, SORTED_AT_ONCE = 4096, 100_000


def _log_bucket(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * _LOG_BUCKETS)).cast("long")


def _in_ranges(ranges: list, what: Callable[[int], Column]) -> Column:
    """what(i) for values in the i-th range (a column's ranges do not overlap), null for all others."""
    out = F.lit(None)
    for i, r in enumerate(ranges):
        inside = (F.col("column_name") == r.column_name) & F.col("v").between(F.lit(r.least), F.lit(r.most))
        out = F.when(inside, what(i)).otherwise(out)
    return out


def _middle(buckets: DataFrame, by: str) -> list:
    """The buckets that hold the middle ranks, two for each column at most.

    `buckets` has (`by`, column_name, b, n, distinct, least, most, before); `before` counts the column's values
    in front of all of them.
    """
    whole = Window.partitionBy(by)
    upto = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("before") + F.sum("n").over(upto) - F.col("n")
    return (buckets.withColumn("before", first)
            .where((F.col("before") + F.col("n") >= F.col("lo")) & (F.col("before") < F.col("hi")))
            .select("column_name", "distinct", "least", "most", "before", "lo", "hi").collect())


def exact_median(df: DataFrame, columns: list[str], at_once: int = SORTED_AT_ONCE) -> DataFrame:
    """Exact medians, one row per column: (column_name, median). Columns without a value have none.

    Values are counted once (map-side combined) and stored. Their counts are summed over monotone logarithmic
    buckets; a bucket that holds a middle rank and more than `at_once` distinct values is divided
    evenly between its least and its greatest value, again and again until it is small, and only then sorted.
    The driver sees two buckets per column at most.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"))
                      for c in columns])
    counted = stored(df.select(F.explode(pairs).alias("p")).select("p.*")
                     .where(~F.isnan("v") & (F.abs("v") < float("inf")))  # null, NaN, infinite: no value
                     .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("least"),
            F.max("v").alias("most")]
    total = F.sum("n").over(Window.partitionBy("column_name"))
    ranges = _middle(counted.groupBy("column_name", _log_bucket(F.col("v")).alias("b")).agg(*sums)
                     .withColumns({"before": F.lit(0).cast("long"), "lo": F.floor((total + 1) / 2),
                                   "hi": F.floor((total + 2) / 2)}), "column_name")
    large = [r for r in ranges if r.distinct > at_once]
    while large:
        # The least value falls into the first part and the greatest into the last: each is smaller than before.
        share = lambda i: F.least(
            F.floor((F.col("v") - large[i].least) / (large[i].most - large[i].least) * _PARTS), F.lit(_PARTS - 1))
        parts = (counted.withColumn("range", _in_ranges(large, F.lit)).where(F.col("range").isNotNull())
                 .groupBy("range", "column_name", _in_ranges(large, share).alias("b")).agg(*sums))
        of = lambda c: F.element_at(F.array(*[F.lit(r[c]) for r in large]), F.col("range") + 1)
        ranges = [r for r in ranges if r.distinct <= at_once] + _middle(
            parts.withColumns({c: of(c) for c in ("before", "lo", "hi")}), "range")
        large = [r for r in ranges if r.distinct > at_once]
    inside = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = lambda c: _in_ranges(ranges, lambda i: F.lit(ranges[i][c])).cast("long")
    ranked = (counted.withColumn("range", _in_ranges(ranges, F.lit)).where(F.col("range").isNotNull())
              .withColumns({c: known(c) for c in ("before", "lo", "hi")})
              .withColumn("last", F.col("before") + F.sum("n").over(inside)))
    at = lambda r: F.max(F.when((F.col("last") - F.col("n") < F.col(r)) & (F.col(r) <= F.col("last")), F.col("v")))
    return ranked.groupBy("column_name").agg(((at("lo") + at("hi")) / 2).alias("median"))
