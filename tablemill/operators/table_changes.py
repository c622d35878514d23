"""Bulk changes of a managed table. Each returns the new content, to be written to a path of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators.filters import apply_filter, combine, predicate
from tablemill.types import spark_type

SYSTEM_COLUMNS = ("__id", "__active")


class ChangeError(ValueError):
    """A change that the table does not allow."""


def _unprotected(name: str) -> None:
    if name.lower() in SYSTEM_COLUMNS:
        raise ChangeError(f"{name} is a system column")


def _present(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ChangeError(f"no column {name}")


def delete_rows(df: DataFrame, where: Any = None, mode: str = "all") -> DataFrame:
    """Rows that stay. A row for which the filter is unknown stays; no filter deletes everything."""
    if not where:
        return df.limit(0)
    test = predicate(where, df, mode) if isinstance(where, Mapping) else combine(list(where), df, mode)
    return df.filter(~F.coalesce(test, F.lit(False)))


def deleted_count(df: DataFrame, where: Any = None, mode: str = "all") -> DataFrame:
    """How many rows a delete removes, as one row."""
    return apply_filter(df, where, mode).agg(F.count(F.lit(1)).alias("deleted"))


def add_column(df: DataFrame, name: str, type_name: str, default: Any = None) -> DataFrame:
    _unprotected(name)
    if name.lower() in [c.lower() for c in df.columns]:
        raise ChangeError(f"column {name} exists")
    return df.withColumn(name, F.lit(default).cast(spark_type(type_name)))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    _unprotected(name)
    _present(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, name: str, new_name: str) -> DataFrame:
    _unprotected(name)
    _unprotected(new_name)
    _present(df, name)
    if new_name.lower() in [c.lower() for c in df.columns if c != name]:
        raise ChangeError(f"column {new_name} exists")
    return df.withColumnRenamed(name, new_name)


def retype_column(df: DataFrame, name: str, type_name: str, strict: bool = True) -> DataFrame:
    """Change a column's type. ``strict`` fails at run time on a value that does not cast; otherwise it becomes null."""
    _unprotected(name)
    _present(df, name)
    column, kind = F.col(f"`{name}`"), spark_type(type_name)
    return df.withColumn(name, column.cast(kind) if strict else column.try_cast(kind))


def retype_loss(df: DataFrame, name: str, type_name: str) -> DataFrame:
    """Values of a column that the new type cannot hold, with their counts."""
    column = F.col(f"`{name}`")
    lost = df.filter(column.isNotNull() & column.try_cast(spark_type(type_name)).isNull())
    return lost.groupBy(column.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def log_entry(table: DataFrame, table_name: str, user: str, description: str) -> DataFrame:
    """One activity-log row about ``table`` with its row count."""
    counted = table.agg(F.count(F.lit(1)).alias("records_count"))
    return counted.select(F.lit(table_name).alias("table_name"), F.lit(user).alias("modified_by"), "records_count",
                          F.lit(description).alias("description"), F.current_timestamp().alias("changed_at"))


def append_log(entries: Sequence[DataFrame], path: str) -> None:
    for entry in entries:
        entry.write.mode("append").parquet(path)
