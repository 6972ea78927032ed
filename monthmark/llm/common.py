"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from monthmark.sources.staging import scratch_path, settle  # noqa: F401 - settle for the operators

#: Words of a text: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored below the shared folder and read back: cuts lineage for good."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send workers at most so many rows at once: a batch of long texts stands in both processes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # Zero or less stands for no bound.
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What this worker keeps between tasks, by operator: how to let go of it.
_KEEPERS: dict[str, Callable[[], None]] = {}


def sole_keeper(operator: str, release: Callable[[], None]) -> None:
    """Called in a worker before an operator fills its cache: those of other operators, whose stages are over, go.

    Spark uses a worker again for later stages, so its caches would add up otherwise.
    """
    for other in [o for o in _KEEPERS if o != operator]:
        _KEEPERS.pop(other)()
    _KEEPERS[operator] = release


def quoted(name: str) -> str:
    """A column name as an exact reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, compared without case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def chunks(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` characters each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def by_bytes(batch, column: int, most: int = 8 << 20):
    """Slices of an Arrow batch with about `most` bytes of the column each."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    marks = np.cumsum(lengths, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


SAFE_NAME = re.compile(r"[^A-Za-z0-9_]+")
