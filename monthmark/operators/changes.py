"""Change detection between the months of a policy.

A month's assignments are never gathered into one array, as a policy may hold any number of
them. Instead each assignment carries the set of months it is in, which is bounded by the
calendar, and is compared with its policy's months: it enters at a month whose predecessor it
lacks, and leaves at the successor of a month when it lacks that. One narrow shuffle keyed by
(policy, assignment) turns a panel into one row per assignment, and only entries and exits,
few of them, travel further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.functions.columns import (assignment_key, index_month, index_year, month_index,
                                         period)
from monthmark.functions.ranking import range_rank
from monthmark.functions.skew import ROWS_PER_SALT, hot_keys, in_ranges, salted_join
from monthmark.operators.aggregates import MONTH

KEYS = ["policy", *MONTH]
MODES = ("present", "calendar")


def _known() -> Column:
    return (F.col("policy").isNotNull() & F.col("inforce_yy").isNotNull()
            & F.col("inforce_mm").isNotNull())


def _calendars(panel: DataFrame) -> DataFrame:
    """Sorted months of each policy, no longer than the calendar, and its number of rows: one row per policy."""
    return panel.where(_known()).groupBy("policy").agg(
        F.array_sort(F.collect_set(month_index())).alias("months"), F.count(F.lit(1)).alias("n"))


def _policy_months(calendars: DataFrame, mode: str) -> DataFrame:
    """(policy, m, has_previous): the months of each policy and whether they are compared."""
    at = F.posexplode("months").alias("_pos", "m")
    previous = F.col("_pos") > 0
    if mode == "calendar":
        previous = previous & (F.get("months", F.col("_pos") - 1) == F.col("m") - 1)
    return calendars.select("policy", "months", at).select(
        "policy", "m", previous.alias("has_previous"))


def _transitions(items: DataFrame, calendars: DataFrame, mode: str) -> DataFrame:
    """(policy, kind, key, m, entered): items that come or go, with the month they do so in.

    `items` has (policy, kind, key, m) in any multiplicity.
    """
    spans = items.where(F.col("key").isNotNull()).groupBy("policy", "kind", "key").agg(
        F.collect_set("m").alias("s"))
    return span_moves(spans, calendars, mode)


def span_moves(spans: DataFrame, calendars: DataFrame, mode: str) -> DataFrame:
    """The same from (policy, kind, key, s), s the distinct months an item is in.

    `calendars` has (policy, months, n), n being the policy's number of rows at least.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # A policy may hold most of the items, its calendar is one row.
    spans = salted_join(spans, calendars.drop("n"), ["policy"], ["kind", "key"], counts=calendars)
    if mode == "present":  # compare positions in the policy's own months
        spans = spans.withColumn("s", F.transform(
            "s", lambda x: F.array_position("months", x).cast("int")))
    spans = spans.withColumn("after", F.transform("s", lambda x: x + 1))
    came, went = F.array_except("s", "after"), F.array_except("after", "s")
    if mode == "present":
        month = lambda p: F.get("months", p - 1)
        came = F.filter(came, lambda p: p > 1)
        went = F.filter(went, lambda p: p <= F.size("months"))
    else:
        month = lambda x: x
        came = F.filter(came, lambda x: F.array_contains("months", x - 1))
        went = F.filter(went, lambda x: F.array_contains("months", x))
    moves = F.concat(
        F.transform(came, lambda x: F.struct(month(x).alias("m"), F.lit(True).alias("entered"))),
        F.transform(went, lambda x: F.struct(month(x).alias("m"), F.lit(False).alias("entered"))))
    return spans.select("policy", "kind", "key", F.explode(moves).alias("x")).select(
        "policy", "kind", "key", "x.m", "x.entered")


def _assignment_items(panel: DataFrame) -> DataFrame:
    return panel.where(_known()).select(
        "policy", F.lit("assignment").alias("kind"), assignment_key().alias("key"),
        month_index().alias("m"))


def _calendar(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("policy", index_year("m").alias("inforce_yy"),
                     index_month("m").alias("inforce_mm"), *columns)


def _changes(panel: DataFrame, mode: str) -> DataFrame:
    calendars = _calendars(panel)
    moves = _transitions(_assignment_items(panel), calendars, mode).select(
        "policy", "m", F.lit(False).alias("has_previous"),
        F.col("entered").cast("long").alias("added"), (~F.col("entered")).cast("long")
        .alias("removed"))
    none = F.lit(0).cast("long")
    months = _policy_months(calendars, mode).withColumns({"added": none, "removed": none})
    return months.unionByName(moves).groupBy("policy", "m").agg(
        F.max("has_previous").alias("has_previous"), F.sum("added").alias("added"),
        F.sum("removed").alias("removed"))


def policy_month_changes(panel: DataFrame, mode: str = "present") -> DataFrame:
    """One row per policy-month: major_change, and assignments added and removed.

    `mode` is the month compared with: the policy's previous present month, or the previous
    calendar month. The first month, and a month without the compared one, is no change.
    """
    out = _changes(panel, mode).withColumn("major_change", (F.col("added") + F.col("removed")) > 0)
    return _calendar(out, "has_previous", "added", "removed", "major_change")


def changed_months(panel: DataFrame, mode: str = "present") -> DataFrame:
    """Only the policy-months with a change, which need no list of all months."""
    moves = _transitions(_assignment_items(panel), _calendars(panel), mode)
    return _calendar(moves.select("policy", "m").distinct())


def flag_panel(panel: DataFrame, changes: DataFrame | None = None,
               mode: str = "present", in_order: bool = False, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The panel with a major_change column; null where the row has no policy or month.

    Only changed policy-months are joined, which are few; a hot policy-month is split by the
    skew handling of the join, as its right side is one row. With `in_order` the rows come sorted by policy, month
    and assignment over the partitions, ready to be written, and whole rows are shuffled once for both.
    """
    if changes is None:
        changed = changed_months(panel, mode)
    else:
        changed = changes.where("major_change").select(*KEYS)
    if in_order:
        return _flagged_in_order(panel, changed, rows_per_salt)
    return (panel.join(changed.withColumn("_changed", F.lit(True)), KEYS, "left")
            .withColumn("major_change", F.when(_known(), F.coalesce("_changed", F.lit(False))))
            .select(*panel.columns, "major_change"))


def _flagged_in_order(panel: DataFrame, changed: DataFrame, rows_per_salt: int) -> DataFrame:
    """Rows and marks of the changed policy-months, dealt together by ranges: a mark flags the rows it comes to lie with.

    A policy-month stays in one range. Those of a hot policy, and rows without policy or month, are also dealt by
    vehicle and driver, `_v` and `_d`; a hot policy-month has a mark for each of its assignments.
    """
    hot = F.broadcast(hot_keys(_calendars(panel), ["policy"], "n", rows_per_salt))  # MOST_HOT rows at most
    tagged = panel.join(hot, F.col("policy") == F.col("_h0"), "left")
    apart = F.col("_salts").isNotNull() | ~_known()
    rows = tagged.withColumns({"_v": F.when(apart, F.col("vehicle_no")), "_d": F.when(apart, F.col("driver_no")),
                               "_mark": F.lit(False)}).drop("_h0", "_salts")
    held = (panel.where(_known()).join(hot, F.col("policy") == F.col("_h0"))
            .select(*KEYS, F.col("vehicle_no").alias("_v"), F.col("driver_no").alias("_d")).distinct())
    marks = (changed.unionByName(changed.join(held, KEYS), allowMissingColumns=True)
             .withColumn("_mark", F.lit(True)))
    deal = [*KEYS, "_v", "_d"]
    both = in_ranges(rows.unionByName(marks, allowMissingColumns=True), deal, panel)
    w = (Window.partitionBy(*deal).orderBy("vehicle_no", "driver_no")
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # The window's own order, so the rows are sorted once.
    return (both.withColumn("_changed", F.max("_mark").over(w)).where(~F.col("_mark"))
            .sortWithinPartitions(*deal, "vehicle_no", "driver_no")
            .withColumn("major_change", F.when(_known(), F.col("_changed"))).select(*panel.columns, "major_change"))


def assignment_moves(panel: DataFrame, mode: str = "calendar") -> DataFrame:
    """Assignments added and removed per policy-month, one row each."""
    moves = _transitions(_assignment_items(panel), _calendars(panel), mode)
    named = moves.select(
        "policy", "m", F.when(F.col("entered"), "added").otherwise("removed").alias("change"),
        F.concat(F.lit("V"), F.replace("key", F.lit("_"), F.lit("-D"))).alias("assignment"))
    return _calendar(named, "change", "assignment")


def change_context(panel: DataFrame) -> DataFrame:
    """What changed in each flagged month, against the previous calendar month.

    A flagged month whose previous calendar month is missing gets one row saying so, and one
    without added or removed assignments a row 'none'.
    """
    flagged = changed_months(panel, "present")
    calendar = _calendar(_policy_months(_calendars(panel), "calendar"), "has_previous")
    base = flagged.join(calendar, KEYS)
    moves = assignment_moves(panel, "calendar")
    return base.join(moves, KEYS, "left").select(
        *KEYS,
        F.when(~F.col("has_previous"), "no_previous_month")
        .otherwise(F.coalesce("change", F.lit("none"))).alias("change"), "assignment")


def _age_jumps(panel: DataFrame) -> DataFrame:
    """(policy, m, before): months of a driver whose age differs by over a year from the month before.

    One row per policy, driver and month before the window, which bounds its groups.
    """
    ages = panel.where(_known() & F.col("driver_no").isNotNull()).groupBy(
        "policy", "driver_no", month_index().alias("m")).agg(F.max("driver_age").alias("age"))
    w = Window.partitionBy("policy", "driver_no").orderBy("m")
    jump = F.abs(F.col("age") - F.lag("age").over(w)) > 1
    return ages.select("policy", "m", F.lag("m").over(w).alias("before"), jump.alias("j")).where("j").drop("j")


def detailed_changes(panel: DataFrame, mode: str = "present") -> DataFrame:
    """Month-level comparison of vehicles, drivers and driver ages.

    A vehicle is its number, VIN, type and model year; a driver its number, licence, name and type, value by
    value: a missing one is a value of its own. An age jump is a driver of both months whose age differs by more than one
    year.
    """
    # Values with their lengths: no two lists of values share a text, and texts sort much faster than structs.
    value = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    item = lambda kind, columns: F.struct(F.lit(kind).alias("kind"), F.concat(
        *[value(F.col(c).cast("string")) for c in columns]).alias("key"))
    items = (panel.where(_known()).select("policy", month_index().alias("m"), F.explode(
        F.array(item("vehicle", _VEHICLE), item("driver", _DRIVER))).alias("i")).select("policy", "i.kind", "i.key", "m"))
    calendars = _calendars(panel)
    moves = _transitions(items, calendars, mode).select("policy", "m", "kind")
    before = F.get("months", F.array_position("months", F.col("m")).cast("int") - 2)
    compared = before if mode == "present" else F.col("m") - 1
    jumps = salted_join(_age_jumps(panel), calendars.drop("n"), ["policy"], ["m", "before"], counts=calendars).where(
        F.col("before") == compared).select("policy", "m", F.lit("age").alias("kind"))
    marks = _policy_months(calendars, mode).select("policy", "m", F.lit("month").alias("kind"))
    any_of = lambda k: F.max(F.col("kind") == k)
    out = marks.unionByName(moves).unionByName(jumps).groupBy("policy", "m").agg(
        any_of("vehicle").alias("vehicle_changed"), any_of("driver").alias("driver_changed"),
        any_of("age").alias("age_jump"))
    out = out.withColumn("major_change",
                         F.col("vehicle_changed") | F.col("driver_changed") | F.col("age_jump"))
    return _calendar(out, "vehicle_changed", "driver_changed", "age_jump", "major_change")


_VEHICLE = ["vehicle_no", "vehicle_vin", "vehicle_type", "model_year"]
_DRIVER = ["driver_no", "driver_license_no", "driver_name", "driver_type"]
_ORDER = ["vehicle_no", "driver_no", "vehicle_vin", "vehicle_type", "model_year",
          "driver_license_no", "driver_name", "driver_type", "driver_age"]


def _identity_differs(a: Column, b: Column) -> Column:
    """Comparison of vehicle and driver in which a missing value equals nothing."""
    out = None
    for c in _VEHICLE + _DRIVER:
        d = F.coalesce(a[c] != b[c], F.lit(True))
        out = d if out is None else out | d
    return out


def _differs(a: Column, b: Column) -> Column:
    return _identity_differs(a, b) | F.coalesce(F.abs(a["driver_age"] - b["driver_age"]) > 1, F.lit(False))


def adjacent_changes(panel: DataFrame) -> DataFrame:
    """Policy-months holding a row that differs from the row before it.

    Rows of a policy are ordered by month and then by all compared columns, the age last; the
    month of the second row is always flagged. Inside a month every pair of neighbours is equal
    exactly when the smallest and the largest row agree but for the age and the distinct ages
    leave no gap, and across months only the last and the first row meet: aggregates suffice,
    no policy is sorted.
    """
    row = F.struct(*_ORDER)
    missing = None
    for c in _VEHICLE + _DRIVER:
        n = F.col(c).isNull()
        missing = n if missing is None else missing | n
    by_age = panel.where(_known()).groupBy(*KEYS, "driver_age").agg(
        F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.max(row).alias("last"),
        F.max(missing).alias("missing"))
    months = by_age.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("missing").alias("missing"),
        F.count("driver_age").alias("ages"), F.min("driver_age").alias("youngest"),
        F.max("driver_age").alias("oldest"))
    gap = F.coalesce(F.col("oldest") - F.col("youngest") + 1 > F.col("ages"), F.lit(False))
    inside = (F.col("n") > 1) & (
        F.col("missing") | _identity_differs(F.col("first"), F.col("last")) | gap)
    w = Window.partitionBy("policy").orderBy(*MONTH)
    months = months.withColumns({
        "previous": F.lag("last").over(w),
        "before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0))})
    second = (F.col("before") < 2) & (F.col("before") + F.col("n") >= 2)
    across = F.col("previous").isNotNull() & _differs(F.col("first"), F.col("previous"))
    return months.select(*KEYS, (second | inside | across).alias("major_change"))


# --- summaries --------------------------------------------------------------------------

def flagged_policy_months(panel: DataFrame, mode: str = "present") -> DataFrame:
    """One row per policy-month: its rows `n` and its flag.

    The summaries below take this as well as a flagged panel; with it the panel is combined
    to policy-months before it is shuffled, instead of being joined row by row.
    """
    counts = panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    changed = changed_months(panel, mode).withColumn("_changed", F.lit(True))
    return counts.join(changed, KEYS, "left").select(
        *KEYS, "n", F.when(_known(), F.coalesce("_changed", F.lit(False))).alias("major_change"))


def _row_counts(flagged: DataFrame) -> tuple[Column, Column]:
    """All rows and changed rows of a flagged panel or of flagged policy-months."""
    if "n" in flagged.columns:
        return F.sum("n"), F.coalesce(F.sum(F.when(F.col("major_change"), F.col("n"))), F.lit(0))
    return F.count(F.lit(1)), F.count_if("major_change")


def _change_rates(flagged: DataFrame) -> list[Column]:
    total, changed = _row_counts(flagged)
    return [total.alias("total_records"), changed.alias("change_count"),
            (F.try_divide(changed, total) * 100).alias("change_rate")]


def change_counts(flagged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows, flagged rows and rate per group."""
    return flagged.groupBy(*by).agg(*_change_rates(flagged))


def change_rollup(flagged: DataFrame) -> DataFrame:
    """Year and month tables in one pass: a null month is the year, both null the total."""
    return flagged.rollup(*MONTH).agg(*_change_rates(flagged))


def changes_by_policy(flagged: DataFrame) -> DataFrame:
    total, changed = _row_counts(flagged)
    return flagged.groupBy("policy").agg(total.alias("total_records"),
                                         changed.alias("change_count"))


def change_summary(flagged: DataFrame) -> DataFrame:
    """Rows and policies with changes, with percentages, from the per-policy counts."""
    per = changes_by_policy(flagged)
    total, changed = F.coalesce(F.sum("total_records"), F.lit(0)), \
        F.coalesce(F.sum("change_count"), F.lit(0))
    policies, with_change = F.count(F.lit(1)), F.count_if(F.col("change_count") > 0)
    rate = lambda a, b: F.coalesce(F.try_divide(a, b) * 100, F.lit(0.0))
    return per.agg(total.alias("total_records"), changed.alias("records_with_changes"),
                   rate(changed, total).alias("change_percentage"),
                   policies.alias("total_policies"), with_change.alias("policies_with_changes"),
                   rate(with_change, policies).alias("policy_change_rate"))


def flagged_months(changes: DataFrame) -> DataFrame:
    return changes.where("major_change").select(*KEYS).distinct()


def change_timeline(changes: DataFrame) -> DataFrame:
    """Flagged months per policy with the policy's count of them."""
    months = flagged_months(changes)
    totals = months.groupBy("policy").agg(F.count(F.lit(1)).alias("change_months"))
    return months.join(totals, "policy")


def change_records(flagged: DataFrame, policy: str | None = None) -> DataFrame:
    """Flagged rows of a policy, or of all."""
    out = flagged.where("major_change")
    if policy is not None:
        out = out.where(F.col("policy") == policy)
    return out.select(*MONTH, "policy", "vehicle_no", "driver_no", "driver_name",
                      "assignment_type")


def first_change(changes: DataFrame) -> DataFrame:
    """Earliest flagged month per policy."""
    first = F.min(period())
    return changes.where("major_change").groupBy("policy").agg(first.alias("first_change_period"))


def next_change(changes: DataFrame) -> DataFrame:
    """For every flagged month of a policy the next one."""
    w = Window.partitionBy("policy").orderBy(*MONTH)
    return flagged_months(changes).withColumn("next_change_period", F.lead(period()).over(w))


def next_change_after(changes: DataFrame, after: int) -> DataFrame:
    """Per policy the first flagged month after a period."""
    return (changes.where(F.col("major_change") & (period() > after)).groupBy("policy")
            .agg(F.min(period()).alias("next_change_period")))


def next_changed_policy(changes: DataFrame) -> DataFrame:
    """For every changed policy the next one in key order, and that one's first change.

    Policies are numbered by a sample sort; the next one has the next number, whatever the keys look like.
    """
    first = first_change(changes).where(F.col("policy").isNotNull())
    numbered = range_rank(first, [], ["policy"], "n")
    target = numbered.select((F.col("n") - 1).alias("n"), F.col("policy").alias("next_policy"),
                             F.col("first_change_period").alias("next_first_change_period"))
    return numbered.join(target, "n", "left").select("policy", "next_policy", "next_first_change_period")


def next_changed_policy_after(changes: DataFrame, current: str) -> DataFrame:
    """The changed policy after `current`; the first of all if `current` has no change.

    One row, or none when `current` is the last changed policy.
    """
    first = first_change(changes)
    p = F.struct("policy", "first_change_period")
    picked = first.agg(
        F.max((F.col("policy") == current).cast("int")).alias("known"),
        F.min(F.when(F.col("policy") > current, p)).alias("after"), F.min(p).alias("any"))
    chosen = F.when(F.col("known") == 1, F.col("after")).otherwise(F.col("any"))
    return picked.select(chosen.alias("x")).where(F.col("x").isNotNull()).select("x.*")
