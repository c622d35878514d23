"""Managed tables and uploaded text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text that counts as missing in an uploaded file.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def read_repository(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """A managed table; only the named columns are read."""
    table = spark.read.parquet(path)
    return table.select([F.col(f"`{c}`") for c in columns]) if columns else table


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False, missing: Sequence[str] = MISSING) -> DataFrame:
    """A UTF-8 file with a header, every column as text and missing markers as null. ``multi_line`` allows line breaks
    inside quotes, at the price of one task per file."""
    raw = spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=multi_line, quote='"', escape='"',
                         encoding="UTF-8", enforceSchema=False)
    return raw.select([F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in raw.columns])
