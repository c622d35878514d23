"""Row-local cleaning of raw text tables, and the clean-up steps as one configured pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.ingest.moments import parse, parse_any
from tablemill.operators.ordering import distinct_rows
from tablemill.types import is_text


def blank_to_null(column: Column) -> Column:
    return F.when(column.rlike(r"^\s*$"), F.lit(None)).otherwise(column)


def drop_empty_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Blank text becomes null, and rows with nothing but nulls go. Columns in ``keep``, such as a row number, do not
    count as content."""
    content = [f.name for f in df.schema.fields if f.name not in keep]
    texts = {f.name: blank_to_null(F.col(f"`{f.name}`")) for f in df.schema.fields if is_text(f.dataType) and f.name in content}
    cleaned = df.withColumns(texts) if texts else df
    return cleaned.dropna(how="all", subset=content)


def plain_number(column: Column, kind: str = "integer") -> Column:
    """Scientific notation in text written out: as a whole number, or for decimal kinds with up to ten decimals. Other
    text comes back trimmed."""
    text = F.trim(column)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), text.try_cast("decimal(38,10)"))
    digits = number.cast("string")
    if any(word in kind.lower() for word in ("numeric", "decimal")):
        written = F.regexp_replace(digits, r"\.?0+$", "")
    else:
        written = F.substring_index(digits, ".", 1)
    written = F.when(written.isin("-0", ""), F.lit("0")).otherwise(written)
    return F.coalesce(written, text)


def column_name(name: str) -> str:
    return name.strip().replace(" ", "_").replace("-", "_").lower()


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[column_name(c) for c in df.columns])


def convert_dates(df: DataFrame, formats: Mapping[str, str | None]) -> DataFrame:
    """Parse whole columns with their detected format, or with any known one where that is None; what does not parse
    becomes null."""
    def moment(name: str, fmt: str | None) -> Column:
        column = F.col(f"`{name}`")
        return parse(column, fmt) if fmt else parse_any(column)

    return df.withColumns({name: moment(name, fmt) for name, fmt in formats.items()}) if formats else df


def clean(df: DataFrame, steps: Mapping[str, Any]) -> DataFrame:
    """Cleaning node: any of ``empty_rows``, ``scientific`` {column: kind}, ``dates`` {column: format}, ``distinct`` and
    ``names``, always applied in this order."""
    if steps.get("empty_rows"):
        df = drop_empty_rows(df, steps.get("keep", ()))
    if steps.get("scientific"):
        df = df.withColumns({c: plain_number(F.col(f"`{c}`"), kind) for c, kind in steps["scientific"].items()})
    if steps.get("dates"):
        df = convert_dates(df, steps["dates"])
    if steps.get("distinct"):
        df = distinct_rows(df, steps.get("row_number"))
    return clean_column_names(df) if steps.get("names") else df
