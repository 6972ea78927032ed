"""Reading panels and master tables from CSV or Parquet folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthmark.schema import MASTERS, PANEL


def _amount(c: Column, kind: T.DataType) -> Column:
    """NaN and infinity are no amounts: null, like any unreadable value."""
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _typed(df: DataFrame, schema: T.StructType, extra: dict[str, T.DataType]) -> DataFrame:
    """Columns by name with the schema's types; unreadable values and absent columns are null."""
    known = {c.lower(): c for c in df.columns}
    wanted = list(schema) + [T.StructField(n, t) for n, t in extra.items() if n.lower() in known]
    out = []
    for f in wanted:
        if f.name.lower() not in known:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(known[f.name.lower()])
        if isinstance(f.dataType, T.DateType):
            c = F.try_to_date(c, "yyyy-MM-dd")
        elif not isinstance(f.dataType, T.StringType):
            c = _amount(c.try_cast(f.dataType), f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
               extra: dict[str, T.DataType] | None = None) -> DataFrame:
    """A table of all files below a path.

    CSV columns are matched by header name, since written files may order them differently;
    types are never inferred, so keys keep their leading zeros.
    """
    extra = extra or {}
    if fmt == "csv":
        return _typed(spark.read.option("header", True).csv(path), schema, extra)
    if fmt == "parquet":
        df = spark.read.parquet(path)
        fields = list(schema) + [T.StructField(n, t) for n, t in extra.items() if n in df.columns]
        return df.select(*[
            _amount((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType), f.dataType)
            .alias(f.name) for f in fields])
    raise ValueError(f"unknown format: {fmt}")


def scan_panel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The panel, with the major_change column if it has been flagged."""
    return read_table(spark, path, PANEL, fmt, {"major_change": T.BooleanType()})


def scan_panel_dir(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """All part files of a panel folder, each row with its file for auditing.

    Choosing one part of many would drop rows, so the whole folder is the panel.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    with_file = raw.withColumn("source_file", F.col("_metadata.file_name"))
    if fmt == "csv":
        return _typed(with_file, PANEL, {"source_file": T.StringType()})
    return with_file.select(*PANEL.fieldNames(), "source_file")


def scan_master(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
    """One master table; an empty one when its path does not exist."""
    schema = MASTERS[name]
    try:
        return read_table(spark, f"{folder.rstrip('/')}/{name}", schema, fmt)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_masters(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    return {name: scan_master(spark, folder, name, fmt) for name in MASTERS}
