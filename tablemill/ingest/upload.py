"""A raw text table made into a typed table: clean, infer, convert, add the system columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.ingest.cleaning import clean_column_names, drop_empty_rows, plain_number
from tablemill.ingest.inference import infer_types
from tablemill.ingest.moments import parse, parse_any
from tablemill.sinks.tables import with_system_columns
from tablemill.types import spark_type

ColumnType = tuple[str, str | None]


def proposed_types(df: DataFrame) -> dict[str, ColumnType]:
    """Inferred (type, date format) per column, for the caller to change before converting. One small row per column."""
    return {r.column_name: (r.inferred_type, r.date_format) for r in infer_types(df).collect()}


def converted(df: DataFrame, types: Mapping[str, ColumnType]) -> DataFrame:
    """Text columns cast to their types, in the order of ``df``. Dates that do not read become null; whole numbers written
    with a fraction of zero are integers."""
    def cast(name: str) -> Column:
        text = F.col(f"`{name}`")
        kind, fmt = types[name]
        target = spark_type(kind)
        if target in ("date", "timestamp_ntz"):
            moment = parse(text, fmt) if fmt else parse_any(text)
            return moment.cast(target)
        if target in ("int", "bigint"):
            return F.regexp_replace(plain_number(text), r"\.0*$", "").cast(target)
        return text if target == "string" else text.cast(target)

    return df.select([cast(c).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def upload(df: DataFrame, types: Mapping[str, ColumnType] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """The table an uploaded text file becomes. ``types`` overrides what is inferred; with ``order_by`` ids are dense."""
    cleaned = clean_column_names(drop_empty_rows(df))
    chosen = {**proposed_types(cleaned), **(types or {})}
    return with_system_columns(converted(cleaned, chosen), order_by)
