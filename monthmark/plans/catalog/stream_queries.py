"""Streaming runs over the fixture tables; their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.plans.registry import query
from monthmark.sources.staging import STORED_AS, scratch_path
from monthmark.streaming import incremental as inc

#: Rows of the panel that one task writes to the files of its thirds.
ROWS_PER_TASK = 100_000


def thirds(panel: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> list[DataFrame]:
    """The panel in three parts, each with rows of every month, in as many files as rows ask for.

    Whole rows are written from where they are: a part is picked out of the panel by a hash, not shuffled.
    """
    part = F.pmod(F.xxhash64("policy", "vehicle_no", "driver_no"), F.lit(3))
    read = panel.coalesce(max(1, panel.count() // rows_per_task))
    return [read.where(part == k) for k in range(3)]


@query("stream_panel_change", "SELECT * FROM ov_flags")
def _(t):
    source, target = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "stream")
    # Every month comes in several files; the later ones and a few earlier ones after the first run.
    late = (F.col("inforce_yy") * 100 + F.col("inforce_mm") > 199806) | (F.col("inforce_mm") == 3)
    parts = thirds(t.panel)

    def arrive(rows: Column) -> None:
        for part in parts:
            part.where(rows).write.mode("append").option("compression", STORED_AS).parquet(source)

    arrive(~late)
    arrived = len(t.spark.read.schema(t.panel.schema).parquet(source).inputFiles())
    # Two of three files a batch, however many a third is.
    inc.run_flag_stream(t.spark, source, target, files_per_batch=-(-2 * arrived // 3))
    arrive(late)
    return inc.run_flag_stream(t.spark, source, target).drop("added", "removed")


@query("stream_event_counts", """
SELECT date AS day, change_type, count(*) AS events, count(vehicle_no) AS with_vehicle
FROM fx_changes_log GROUP BY date, change_type""")
def _(t):
    log = t.changes_log
    source = scratch_path(t.spark, "events")
    log.write.parquet(source)
    return inc.run_event_counts(t.spark, source, log.schema, scratch_path(t.spark, "counts"))
