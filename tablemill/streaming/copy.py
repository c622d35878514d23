"""Copying a growing folder of files to a table in batches that survive a restart.

Row-local operators (filters, projections, calculated columns, rules) take a streaming DataFrame as they take any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def copy_new_files(spark: SparkSession, source: str, target: str, schema: T.StructType, progress: str, files_per_batch: int = 1000,
                   step: Callable[[DataFrame], DataFrame] = lambda df: df, names: str = "*") -> None:
    """Append every Parquet file of ``source`` that was not copied before to the Parquet table ``target``, then stop.
    ``names`` picks files by name. ``progress`` is a folder, shared by all executors, that remembers what was copied; a
    run that dies is continued by the next."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names)
    stream = reader.parquet(source)
    query = (step(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", progress)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
