"""Derived tables written once per session to the shared folder.

A staged table cuts lineage and survives the loss of any executor: later queries read
Parquet with pruned columns instead of repeating the joins that made it. It counts for one state of
its source's files, and is deleted with the session.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: How derived tables are compressed: written once, they take less of the shared folder than by the default.
STORED_AS = "zstd"

#: (application, source, name) -> (state of the source's files, path, schema)
_STAGED: dict[tuple[str, str, str], tuple[str, str, T.StructType]] = {}
#: Shared folder and folder for derived tables of each application.
_LOCAL_ROOTS: dict[str, str] = {}
_SCRATCH: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where everything is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="monthmark-")
        at, system = _at(spark, _LOCAL_ROOTS[app])
        system.deleteOnExit(at)
    return _LOCAL_ROOTS[app]


def _at(spark: SparkSession, path: str):
    """A path and the file system it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, in a folder that goes when the session's driver ends."""
    root, app = shared_folder(spark).rstrip("/"), spark.sparkContext.applicationId
    if (app, root) not in _SCRATCH:
        folder = f"{root}/monthmark/{app}-{uuid.uuid4().hex}"
        at, system = _at(spark, folder)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _SCRATCH[app, root] = folder
    return f"{_SCRATCH[app, root]}/{name}-{uuid.uuid4().hex}"


def source_state(spark: SparkSession, folder: str) -> str:
    """Names, times, sizes and numbers of files of a folder's tables: differs once one of them is rewritten."""
    at, system = _at(spark, folder)
    state = []
    for entry in system.listStatus(at):
        held = system.getContentSummary(entry.getPath())
        state.append(f"{entry.getPath().getName()}:{entry.getModificationTime()}:{held.getLength()}:{held.getFileCount()}")
    return "\n".join(sorted(state))


def release(spark: SparkSession) -> None:
    """Delete what this session has derived so far; tables read from it must not be used any more."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STAGED if k[0] == app]:
        del _STAGED[key]
    mine = [k for k in _SCRATCH if k[0] == app]
    removed(spark, [_SCRATCH.pop(k) for k in mine])


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of whatever store they are in; those that are gone already are passed over."""
    for path in paths:
        at, system = _at(spark, path)
        system.delete(at, True)


def settle(spark: SparkSession) -> None:
    """Let go of what finished jobs left: shuffles on disk, and on the driver plans, generated code, broadcasts.

    Spark's cleaner drops them only after the JVM has collected garbage, which a roomy heap puts off while it grows.
    """
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read back: later steps see them as they are now."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", STORED_AS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame],
           partition_by: tuple[str, ...] = (), state: str | None = None, dealt: bool = False) -> DataFrame:
    """Write build() once per session and state of the source's files, and read it back with its schema.

    `state` spares looking it up where it is known. A table of an earlier state stays until the session ends, as
    plans may still read it. With `dealt` the rows of build() are rebalanced by `partition_by` already.
    """
    key = (spark.sparkContext.applicationId, source.rstrip("/"), name)
    state = source_state(spark, source) if state is None else state
    if key not in _STAGED or _STAGED[key][0] != state:
        df = build()
        path = scratch_path(spark, name)
        writer = df
        if partition_by and not dealt:
            # Rebalancing splits a partition that is too large and merges small ones.
            writer = df.hint("rebalance", *partition_by)
        writer.write.option("compression", STORED_AS).partitionBy(*partition_by).parquet(path)
        _STAGED[key] = (state, path, df.schema)
        settle(spark)  # the shuffles behind the table are larger than it
    _, path, schema = _STAGED[key]
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.read.schema(nullable).parquet(path).select(*schema.fieldNames())
