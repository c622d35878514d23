"""Row counts, minima and maxima of Parquet folders from the footers of their files, without reading a row group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import stage

#: Types whose footers hold exact bounds. Texts may be cut there, and bounds of fractions do not tell about NaN.
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, with its settings, whose Parquet scans answer aggregates from footers. The settings of ``spark`` itself stay."""
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        value = spark.conf.get(key, None)
        if value is not None and session.conf.get(key, None) != value:
            session.conf.set(key, value)
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_plan(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row (row_count, min_<column>, max_<column>, ...) planned over footers; a frame of ``footer_session``."""
    table = footer_session(spark).read.parquet(path)
    wrong = [c for c in columns if not isinstance(table.schema[c].dataType, EXACT)]
    if wrong:
        raise ValueError(f"footers hold no exact bounds of {', '.join(wrong)}")
    return table.agg(*_measures(columns))


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row (row_count, min_<column>, max_<column>, ...) about the Parquet files at ``path``, as a scan would give it.

    ``columns`` are whole numbers or dates. Tasks read footers only, so the work grows with the row groups and not the rows. Where a file has no
    bounds for a column (all its values are null, or its writer left them out) the columns are scanned instead.
    """
    plan = footer_plan(spark, path, columns)
    try:
        kept = stage(plan, "footers")
    except PySparkException:  # a file without bounds: Spark refuses the footers instead of scanning
        kept = stage(spark.read.parquet(path).agg(*_measures(columns)), "footers")
    paths = kept.inputFiles()
    # files without any row group give a null count; only a frame read back tells Spark that it may be null
    return spark.read.schema(plan.schema).parquet(*paths).withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))


def _measures(columns: Sequence[str]) -> list:
    bounds = [f(F.col(f"`{c}`")).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return [F.count(F.lit(1)).alias("row_count"), *bounds]
