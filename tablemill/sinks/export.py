"""Text exports of filtered and sorted tables, and the value forms they use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.filters import apply_filter
from tablemill.operators.ordering import sort
from tablemill.patterns import java_date_pattern
from tablemill.types import is_moment

# User date pattern -> Java pattern; lower-case mm are minutes.
DATE_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "SS": "ss"}
NULL_TEXT = "None"


def date_pattern(user_format: str) -> str:
    return java_date_pattern(user_format, DATE_TOKENS)


def formatted_date(column: Column, kind: T.DataType, user_format: str) -> Column:
    """Date as text; a timestamp that is not at midnight also shows its time."""
    pattern = date_pattern(user_format)
    day = F.date_format(column, pattern)
    if not is_moment(kind):
        return day
    midnight = (F.hour(column) == 0) & (F.minute(column) == 0) & (F.floor(F.second(column)) == 0)
    return F.when(midnight, day).otherwise(F.date_format(column, f"{pattern} HH:mm:ss"))


def format_dates(df: DataFrame, user_format: str) -> DataFrame:
    """All date and timestamp columns as text in the user's format."""
    dated = {f.name: formatted_date(F.col(f"`{f.name}`"), f.dataType, user_format) for f in df.schema.fields
             if isinstance(f.dataType, T.DateType) or is_moment(f.dataType)}
    return df.withColumns(dated) if dated else df


def plain_value(column: Column, kind: T.DataType) -> Column:
    """Exchange form of a value: decimals as double, dates as ISO text, binary as UTF-8 text or else base64."""
    if isinstance(kind, T.DecimalType):
        return column.cast("double")
    if is_moment(kind):
        micros = F.date_format(column, "SSSSSS") != "000000"
        return F.when(micros, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"))
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.when(F.is_valid_utf8(column.cast("string")), column.cast("string")).otherwise(F.base64(column))
    return column


def plain_values(df: DataFrame) -> DataFrame:
    return df.select([plain_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def export_rows(df: DataFrame, columns: Sequence[str] = (), where: Any = None, order: Sequence[Mapping[str, str] | str] = (),
                date_format: str = "YYYY-MM-DD") -> DataFrame:
    """Rows of an export as text: filtered, sorted, chosen columns, dates in the user's format, null as ``None``."""
    rows = apply_filter(df, where)
    rows = sort(rows, order) if order else rows
    rows = rows.select([F.col(f"`{c}`") for c in columns]) if columns else rows
    dated = format_dates(rows, date_format)
    return dated.select([F.coalesce(_as_text(F.col(f"`{f.name}`"), f.dataType), F.lit(NULL_TEXT)).alias(f.name) for f in dated.schema.fields])


def _as_text(column: Column, kind: T.DataType) -> Column:
    return F.initcap(column.cast("string")) if isinstance(kind, T.BooleanType) else column.cast("string")


def write_csv(rows: DataFrame, path: str) -> None:
    """Comma-separated part files with header; quotes double inside quoted values."""
    rows.write.csv(path, header=True, sep=",", quote='"', escape='"', emptyValue="")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated part files with header, nothing quoted. A backslash, tab, line feed or carriage return inside a name or a value is
    written as a backslash and one more character (``\\\\``, ``\\t``, ``\\n``, ``\\r``), so a row is a line and values read back."""
    plain = [_one_line(F.col(f"`{c}`").cast("string")).alias(_one_line_name(c)) for c in rows.columns]
    rows.select(plain).write.csv(path, header=True, sep="\t", quote="", emptyValue="")


# What stands for a character that would break a line or a field.
TSV_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def read_tsv_value(text: Column) -> Column:
    """A value as it was before ``write_tsv`` escaped it."""
    # a doubled backslash steps aside first, so that what follows it is not taken for an escape
    aside = "\x00"
    text = F.replace(text, F.lit("\\\\"), F.lit(aside))
    for character, written in TSV_ESCAPES[1:]:
        text = F.replace(text, F.lit(written), F.lit(character))
    return F.replace(text, F.lit(aside), F.lit("\\"))


def _one_line(text: Column) -> Column:
    for character, written in TSV_ESCAPES:
        text = F.replace(text, F.lit(character), F.lit(written))
    return text


def _one_line_name(name: str) -> str:
    for character, written in TSV_ESCAPES:
        name = name.replace(character, written)
    return name
