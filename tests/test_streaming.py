"""Streams against the batch operators."""

import os

from pyspark.sql import functions as F

from monthmark.operators.changes import policy_month_changes
from monthmark.streaming import incremental as inc
from tests.test_changes import month, random_rows


def keyed(df):
    return sorted((r.policy, r.inforce_yy, r.inforce_mm, r.added, r.removed, r.major_change)
                  for r in df.collect())


def test_months_arriving_one_by_one(spark, panel_of, tmp_path):
    panel = panel_of(random_rows(21))
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    periods = sorted(r.p for r in panel.select(
        (F.col("inforce_yy") * 100 + F.col("inforce_mm")).alias("p")).distinct().collect())
    for p in (periods[:3], periods[3:4], periods[4:]):
        part = panel.where((F.col("inforce_yy") * 100 + F.col("inforce_mm")).isin(p))
        part.coalesce(1).write.mode("append").parquet(source)
        out = inc.run_flag_stream(spark, source, target)
    assert keyed(out) == keyed(policy_month_changes(panel))


def test_one_file_a_batch_with_each_month_in_three_files(spark, panel_of, tmp_path):
    panel = panel_of(random_rows(5))
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    panel.repartition(3, F.xxhash64("vehicle_no", "driver_no", "inforce_mm")).write.parquet(source)
    out = inc.run_flag_stream(spark, source, target, files_per_batch=1)
    assert keyed(out) == keyed(policy_month_changes(panel))


def test_thirds_of_a_panel_are_written_without_a_shuffle(spark, panel_of, tmp_path):
    from monthmark.plans.catalog.stream_queries import thirds

    panel_of(random_rows(5)).repartition(4, "inforce_mm").write.parquet(f"{tmp_path}/panel")
    panel = spark.read.parquet(f"{tmp_path}/panel")
    parts = thirds(panel)
    assert [p.rdd.getNumPartitions() for p in parts] == [1, 1, 1]  # few rows, one file a third
    assert all(p.rdd.getNumPartitions() == panel.rdd.getNumPartitions() for p in thirds(panel, rows_per_task=1))
    for part in parts:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(parts[0].union(parts[1]).union(parts[2])) == rows(panel)
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in parts:
        part.write.mode("append").parquet(source)
    assert keyed(inc.run_flag_stream(spark, source, target, files_per_batch=2)) == keyed(policy_month_changes(panel))
    assert len(os.listdir(f"{target}/flags")) == 2


def test_split_month_is_one_month(spark, panel_of, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    both = (("01", "01"), ("02", "01"))
    for rows in (month(2018, 1, *both), month(2018, 2, both[0]), month(2018, 2, both[1])):
        panel_of(rows).coalesce(1).write.mode("append").parquet(source)
        out = inc.run_flag_stream(spark, source, target)
    assert keyed(out) == [("p", 2018, 1, 0, 0, False), ("p", 2018, 2, 0, 0, False)]


def test_late_month_updates_its_own_and_the_next_flag(spark, panel_of, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in (month(2018, 1, ("01", "01")) + month(2018, 3, ("01", "01")), month(2018, 2, ("02", "01"))):
        panel_of(rows).coalesce(1).write.mode("append").parquet(source)
        out = inc.run_flag_stream(spark, source, target)
    assert keyed(out) == [("p", 2018, 1, 0, 0, False), ("p", 2018, 2, 1, 1, True), ("p", 2018, 3, 1, 1, True)]


def test_state_holds_changed_policies_only(spark, panel_of, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [{**r, "policy": p} for p in ("p", "q") for r in month(2018, 1, ("01", "01"))]
    panel_of(first).coalesce(1).write.mode("append").parquet(source)
    inc.run_flag_stream(spark, source, target)
    panel_of(month(2018, 1, ("01", "01")) + month(2018, 2, ("01", "01"))).coalesce(1).write.mode("append").parquet(source)
    inc.run_flag_stream(spark, source, target)
    touched = {r["p"] for r in spark.createDataFrame([("p",)], "p string").select(inc.bucket_of("p", inc.BUCKETS).alias("p")).collect()}
    assert {r.bucket for r in spark.read.parquet(f"{target}/state/batch=1").collect()} == touched
    last = spark.read.parquet(f"{target}/flags/batch=1").collect()
    assert sorted((r.policy, r.inforce_mm) for r in last) == [("p", 1), ("p", 2)]
    assert {r.policy for r in spark.read.parquet(f"{target}/flags/batch=1").collect()} == {"p"}


def bytes_of(df):
    return sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles())


def test_reads_do_not_grow_with_batches(spark, panel_of, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    pairs = [(f"{v:02d}", "01") for v in range(4)]
    rows = lambda y, m: [{**r, "policy": f"p{p:03d}"} for p in range(40) for r in month(y, m, *pairs[: 3 + (p + m) % 2])]
    months = [(2018 + k // 12, k % 12 + 1) for k in range(14)]
    read, flagged = [], []
    for k, (y, m) in enumerate(months):
        panel_of(rows(y, m)).coalesce(1).write.mode("append").parquet(source)
        buckets = list(range(8))
        if k:
            known = inc.known_state(spark, target, k, buckets)
            read.append((bytes_of(known), known.count()))
        out = inc.run_flag_stream(spark, source, target, buckets=8)
        flagged.append(spark.read.parquet(f"{target}/flags/batch={k}").count())
    assert read[12][1] == read[1][1] == 160  # one row for each assignment
    # An assignment that comes and goes has a run a visit; the others stay one run.
    assert read[12][0] < 1.5 * read[2][0]
    assert set(flagged) == {40}
    assert keyed(out) == keyed(policy_month_changes(spark.read.parquet(source)))
    # Versions that were left behind are gone: the last batch's and those it may need again.
    assert {r.batch for r in spark.read.parquet(f"{target}/state").select("batch").distinct().collect()} <= {12, 13}
    # A late correction of one policy reads one bucket.
    assert len({f.split("bucket=")[1].split("/")[0] for f in inc.known_state(spark, target, 14, [3]).inputFiles()}) == 1


def test_repeated_batch_and_calendar_mode(spark, panel_of, tmp_path):
    for mode in ("present", "calendar"):
        panel = panel_of(random_rows(8)).cache()
        source, target = f"{tmp_path}/in-{mode}", f"{tmp_path}/out-{mode}"
        panel.repartition(5, F.xxhash64("inforce_mm", "driver_no")).write.parquet(source)
        inc.run_flag_stream(spark, source, target, files_per_batch=2, buckets=4, mode=mode)
        # The last batch is run again, as after a failure before its commit.
        commits = sorted(os.listdir(f"{target}/checkpoint/commits"), key=lambda n: (n.startswith("."), n))
        last = max(int(n) for n in commits if n.isdigit())
        for n in (f"{last}", f".{last}.crc"):
            os.remove(f"{target}/checkpoint/commits/{n}")
        out = inc.run_flag_stream(spark, source, target, files_per_batch=2, buckets=4, mode=mode)
        assert keyed(out) == keyed(policy_month_changes(panel, mode))


def test_runs_of_months(spark):
    df = spark.createDataFrame([([5, 3, 4, 9, 11, 10],), ([7],), ([],)], "m array<int>")
    got = df.select(inc.runs_of(F.col("m")).alias("r"), inc.months_of(inc.runs_of(F.col("m"))).alias("m")).collect()
    assert [[tuple(x) for x in r.r] for r in got] == [[(3, 5), (9, 11)], [(7, 7)], []]
    assert [r.m for r in got] == [[3, 4, 5, 9, 10, 11], [7], []]


def test_late_events_count_once(spark, tmp_path):
    from datetime import date

    source, target, schema = f"{tmp_path}/in", f"{tmp_path}/out", "date date, change_type string, vehicle_no string"
    log = [[(date(2020, 1, 1), "add", "1"), (date(2020, 1, 2), "add", None)], [(date(2020, 3, 1), "drop", "2")],
           [(date(2020, 1, 1), "add", "3"), (date(2020, 2, 27), "add", "4"), (None, "add", "5")]]
    for rows in log:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = inc.run_event_counts(spark, source, spark.read.parquet(source).schema, target)
    assert {tuple(r) for r in out.collect()} == {
        (date(2020, 1, 1), "add", 2, 2), (date(2020, 1, 2), "add", 1, 0), (date(2020, 3, 1), "drop", 1, 1),
        (date(2020, 2, 27), "add", 1, 1), (None, "add", 1, 1)}
    assert [tuple(r) for r in inc.counted_events(spark, target, late=True).collect()] == [(date(2020, 1, 1), "add", 1, 1)]
