"""Writing panels, reports, master tables and the change log."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from monthmark.functions.skew import in_ranges
from monthmark.schema import CHANGES_LOG
from monthmark.sources.staging import STORED_AS, settle

# The two row orders of a written panel.
POLICY_ORDER = ("policy", "inforce_yy", "inforce_mm")
FULL_ORDER = ("policy", "policy_expiry_date", "vehicle_no", "driver_no", "inforce_yy",
              "inforce_mm")

#: How panels are compressed; a reader cannot split a compressed CSV file, so each holds so many rows at most.
PANEL_CODECS, PANEL_FILE_ROWS = {"csv": "gzip", "parquet": STORED_AS}, 1_000_000


def write_csv(df: DataFrame, path: str, header: bool = True, single_file: bool = False) -> str:
    """Overwrite a CSV folder; one file only for small reports, as it is one task."""
    # A shuffle, so that only the last sorting of rows is one task, not the work before it.
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", header).csv(path)
    return path


def write_panel(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Overwrite a panel folder with the rows as they lie, compressed: a plain CSV panel takes about five times the disk."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("maxRecordsPerFile", PANEL_FILE_ROWS)
    if fmt in PANEL_CODECS:
        writer = writer.option("compression", PANEL_CODECS[fmt])
    writer.format(fmt).save(path)
    settle(df.sparkSession)  # shuffles of whole rows
    return path


def sorted_panel(df: DataFrame, order: tuple[str, ...] = POLICY_ORDER) -> DataFrame:
    """Rows in global order over the output files.

    The assignment's numbers break ties, so ranges can also split a policy-month with most of
    the rows.
    """
    full = [*order, *[c for c in ("vehicle_no", "driver_no")
                      if c in df.columns and c not in order]]
    return in_ranges(df, full, df).sortWithinPartitions(*full)


def write_sorted_panel(df: DataFrame, path: str, order: tuple[str, ...] = POLICY_ORDER,
                       fmt: str = "csv", in_order: bool = False) -> str:
    """A panel folder in global order; with `in_order` the rows come in it already."""
    return write_panel(df if in_order else sorted_panel(df, order), path, fmt)


def write_partitioned_panel(df: DataFrame, path: str) -> str:
    """Parquet by month, for pruning; rebalancing keeps a large month in many files."""
    (df.hint("rebalance", "inforce_yy", "inforce_mm").write.mode("overwrite")
     .partitionBy("inforce_yy", "inforce_mm").parquet(path))
    return path


def write_report_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder per report table (a row per month, type or metric: one file each)."""
    return {name: write_csv(df, f"{folder.rstrip('/')}/{name}", single_file=True)
            for name, df in tables.items()}


def aligned_log(log: DataFrame) -> DataFrame:
    """A log of any event types with the columns of the whole log."""
    return log.select(*[
        (F.col(f.name) if f.name in log.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CHANGES_LOG])


def append_changes_log(log: DataFrame, path: str, fmt: str = "csv") -> str:
    """Append events; every append has the same columns, so files can be read together."""
    writer = aligned_log(log).write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_masters(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> str:
    """Master tables with columns in alphabetical order."""
    for name, df in tables.items():
        writer = df.select(*sorted(df.columns)).write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{folder.rstrip('/')}/{name}")
    return folder


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a DataFrame for several reports and release it afterwards."""
    held = df.persist(level)
    try:
        yield held
    finally:
        held.unpersist()
