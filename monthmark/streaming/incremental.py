"""Keeping change flags and event counts up to date as files arrive.

Months arrive as Parquet files, in any order and split over any files. What is known is kept as state
keyed by policy: one row for each assignment with the runs of months it is in, dealt by a hash of the policy
into buckets. A micro-batch reads the buckets its policies are in, merges its rows into them and writes them
as a new version; it then flags the months it brought and the ones that follow them. Neither
reads nor writes grow with the number of batches before, only with what a batch brings and
the assignments of the policies beside it. Whatever the order, the latest flags equal one batch run over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from monthmark.functions.columns import assignment_key, index_month, index_year, month_index
from monthmark.operators.changes import KEYS, span_moves
from monthmark.schema import PANEL
from monthmark.sources.staging import removed

STATE = ["policy", "inforce_yy", "inforce_mm", "vehicle_no", "driver_no"]
FLAGS = [*KEYS, "added", "removed", "major_change"]
ITEM = ["policy", "vehicle_no", "driver_no"]
STORED = ("policy string, vehicle_no string, driver_no string, runs array<struct<a: int, z: int>>, "
          "batch long, bucket int")

#: Buckets of the state. A bucket is read and written as a whole, in as many files as its size asks for.
BUCKETS = 64


def bucket_of(policy: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(policy), F.lit(buckets)).cast("int")


def runs_of(months: Column) -> Column:
    """Distinct months as ascending runs [a, z]: an assignment that stays is one run, however long."""
    empty = F.array().cast("array<struct<a: int, z: int>>")
    one = lambda a, z: F.array(F.struct(a.alias("a"), z.alias("z")))

    def add(runs: Column, m: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), one(last["a"], m))
        return F.when(last["z"] == m - 1, longer).otherwise(F.concat(runs, one(m, m)))

    return F.aggregate(F.array_sort(months), empty, add)


def months_of(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["z"])))


def fresh_spans(new: DataFrame) -> DataFrame:
    """(policy, vehicle_no, driver_no, s): the months each assignment is in, by a batch's rows."""
    known = F.col("policy").isNotNull() & F.col("inforce_yy").isNotNull() & F.col("inforce_mm").isNotNull()
    return new.where(known).groupBy(*ITEM).agg(F.collect_set(month_index().cast("int")).alias("s"))


def merged(known: DataFrame, fresh: DataFrame, buckets: int) -> DataFrame:
    """State rows of the buckets after a batch."""
    both = known.select(*ITEM, months_of(F.col("runs")).alias("s")).unionByName(fresh)
    # Two arrays at most meet: what was known of an assignment, and what is new.
    whole = F.array_distinct(F.flatten(F.collect_list("s")))
    return both.groupBy(*ITEM).agg(runs_of(whole).alias("runs")).withColumn("bucket", bucket_of("policy", buckets))


def flags_after(state: DataFrame, fresh: DataFrame, mode: str = "present") -> DataFrame:
    """Flags of the policy-months that a batch brought and of those that follow them.

    `state` holds the batch already. Other months of the policies keep the flags they have.
    """
    # Sets of months are bounded by the calendar, whatever a policy holds.
    brought = fresh.select("policy", F.explode("s").alias("m")).groupBy("policy").agg(F.collect_set("m").alias("brought"))
    items = state.join(brought.select("policy"), "policy", "left_semi").withColumn("s", months_of(F.col("runs")))
    calendars = items.select("policy", F.explode("s").alias("m")).groupBy("policy").agg(
        F.array_sort(F.collect_set("m")).alias("months"), F.count(F.lit(1)).alias("n"))
    before = lambda i: F.get("months", i - 1)
    if mode == "present":
        follows = lambda m, i: F.coalesce(F.array_contains("brought", before(i)), F.lit(False))
    else:
        follows = lambda m, i: F.array_contains("brought", m - 1)
    hit = F.filter("months", lambda m, i: F.array_contains("brought", m) | follows(m, i))
    months = calendars.join(brought, "policy").select("policy", F.explode(hit).alias("m")).withColumns(
        {"added": F.lit(0).cast("long"), "removed": F.lit(0).cast("long"), "own": F.lit(True)})
    # A null number makes no assignment, but its row is a month of the policy.
    spans = items.select("policy", F.lit("assignment").alias("kind"), assignment_key().alias("key"), "s").where("key IS NOT NULL")
    moves = span_moves(spans, calendars, mode).select(
        "policy", "m", F.col("entered").cast("long").alias("added"), (~F.col("entered")).cast("long").alias("removed"),
        F.lit(False).alias("own"))
    out = months.unionByName(moves).groupBy("policy", "m").agg(
        F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("own").alias("own")).where("own")
    return out.select("policy", index_year("m").alias("inforce_yy"), index_month("m").alias("inforce_mm"), "added", "removed",
                      (F.col("added") + F.col("removed") > 0).alias("major_change"))


def versions(spark: SparkSession, root: str, batch: int) -> dict[int, int]:
    """The batch that wrote the valid version of each bucket, before `batch`. As many entries as buckets at most."""
    if batch <= 0:
        return {}
    rows = spark.read.schema("bucket int, version long").parquet(f"{root}/versions/batch={batch - 1}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def known_state(spark: SparkSession, root: str, batch: int, buckets: list[int]) -> DataFrame:
    """State rows of some buckets before `batch`; files of other buckets and older versions are not read."""
    at = versions(spark, root, batch)
    paths = [f"{root}/state/batch={at[b]}/bucket={b}" for b in sorted(buckets) if b in at]
    if not paths:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", f"{root}/state").parquet(*paths)


def latest(batches: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of rows written by several batches the one of the last batch."""
    return batches.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in values])


def flag_stream(spark: SparkSession, source: str, target: str, files_per_batch: int | None = None,
                buckets: int = BUCKETS, mode: str = "present") -> DataStreamWriter:
    """A stream over a panel folder that writes flags and state below `target`.

    A batch writes to folders named by its id and reads the versions that the batch before it lists. A batch
    repeated after a failure therefore overwrites its own output: results are exactly once. Versions
    that two committed batches have left behind are deleted. The number of buckets is fixed with the first batch.
    """
    root = target.rstrip("/")

    def process(batch_df: DataFrame, batch: int) -> None:
        fresh = fresh_spans(batch_df).withColumn("bucket", bucket_of("policy", buckets))
        arrived = f"{root}/arrived/batch={batch}"
        fresh.write.mode("overwrite").parquet(arrived)
        fresh = spark.read.schema(fresh.schema).parquet(arrived)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        before = versions(spark, root, batch)
        after = merged(known_state(spark, root, batch, touched), fresh.drop("bucket"), buckets)
        # A bucket with a large policy becomes many files.
        (after.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{root}/state/batch={batch}"))
        now = {**before, **dict.fromkeys(touched, batch)}
        spark.createDataFrame([*now.items()], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{root}/versions/batch={batch}")
        state = known_state(spark, root, batch + 1, touched)
        flags_after(state, fresh, mode).write.mode("overwrite").parquet(f"{root}/flags/batch={batch}")
        # This batch may be repeated and needs what it read; the one before it is committed.
        older = versions(spark, root, batch - 1)
        removed(spark, [f"{root}/state/batch={v}/bucket={b}" for b, v in older.items() if before[b] != v]
                + [f"{root}/arrived/batch={batch - 1}", f"{root}/versions/batch={batch - 3}"])

    reader = spark.readStream.schema(PANEL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.parquet(source).writeStream.foreachBatch(process)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True))


def run_flag_stream(spark: SparkSession, source: str, target: str, files_per_batch: int | None = None,
                    buckets: int = BUCKETS, mode: str = "present") -> DataFrame:
    """Process what has arrived and return the latest flags of all policy-months."""
    flag_stream(spark, source, target, files_per_batch, buckets, mode).start().awaitTermination()
    return latest(spark.read.parquet(f"{target.rstrip('/')}/flags"), KEYS,
                  ["added", "removed", "major_change"])


def event_counts(events: DataFrame, watermark: str = "7 days", width: str = "1 day") -> DataFrame:
    """Events per type and time window of a change-log stream (or table)."""
    timed = events.withColumn("ts", F.col("date").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", width), "change_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("vehicle_no").alias("with_vehicle")).select(
            F.col("window.start").cast("date").alias("day"), "change_type", "events",
            "with_vehicle")


def count_batch(events: DataFrame, seen: Column, watermark: str) -> DataFrame:
    """(day, change_type, late, events, with_vehicle) of one batch.

    Late are events of days that had ended `watermark` before the latest event of earlier batches, `seen`.
    """
    ended = (F.date_add("day", 1).cast("timestamp") <= seen - F.expr(f"INTERVAL {watermark}"))
    return (events.withColumn("day", F.col("date").cast("date")).withColumn("late", F.coalesce(ended, F.lit(False)))
            .groupBy("day", "change_type", "late")
            .agg(F.count(F.lit(1)).alias("events"), F.count("vehicle_no").alias("with_vehicle")))


def run_event_counts(spark: SparkSession, source: str, schema, target: str, watermark: str = "7 days",
                     files_per_batch: int | None = None) -> DataFrame:
    """Count the events of a log folder as a stream, whenever they come; events without date count under no day.

    Each batch writes what it adds to the counts to a folder of its own, so a repeated batch counts nothing
    twice and no state is carried but the latest time seen. Events behind the watermark go to a side table,
    `late=true`: reports that were already taken from the on-time counts are corrected by adding it.
    """
    root = target.rstrip("/")

    def process(batch_df: DataFrame, batch: int) -> None:
        before = None
        if batch > 0:
            before = spark.read.schema("seen timestamp").parquet(f"{root}/seen/batch={batch - 1}").first()["seen"]
        seen = F.lit(before).cast("timestamp")
        latest_here = batch_df.agg(F.max(F.col("date").cast("timestamp")).alias("m"))
        latest_here.select(F.greatest("m", seen).alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{root}/seen/batch={batch}")
        (count_batch(batch_df, seen, watermark).write.mode("overwrite").partitionBy("late")
         .parquet(f"{root}/counts/batch={batch}"))

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    (reader.parquet(source).writeStream.foreachBatch(process)
     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    return counted_events(spark, target)


def counted_events(spark: SparkSession, target: str, late: bool | None = None) -> DataFrame:
    """(day, change_type, events, with_vehicle): all events counted so far, or only those in time, or only late ones."""
    rows = spark.read.schema("day date, change_type string, events long, with_vehicle long, batch long, late boolean").parquet(
        f"{target.rstrip('/')}/counts")
    rows = rows if late is None else rows.where(F.col("late") == late)
    return rows.groupBy("day", "change_type").agg(F.sum("events").alias("events"), F.sum("with_vehicle").alias("with_vehicle"))
