"""Column profiles: one aggregation per table for the numbers, and value lists judged against reference tables.

Code lists, country-region pairs and the like are tables the caller passes. Values are counted before they meet such a
table, so the join sees each distinct value once; the reference side is broadcast only when its counted size allows.
Profiles with lists come as rows of (finding, value, n) or (finding, group_value, value, n).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.ingest.moments import DATE_FORMATS, parse_any
from tablemill.session import broadcast_if_small, fits_broadcast

Normaliser = Callable[[Column], Column]


def trimmed(column: Column) -> Column:
    return F.trim(column)


def upper_code(column: Column) -> Column:
    return F.upper(F.trim(column))


def lower_code(column: Column) -> Column:
    return F.lower(F.trim(column))


def as_is[Value](value: Value) -> Value:
    return value


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, min_value, max_value, exact_min, exact_max, total_count, zero_count, null_count) per column, in one pass.

    ``min_value`` and ``max_value`` are doubles; for integers and decimals, which a double may not hold, ``exact_min`` and ``exact_max`` are the
    values as text."""
    measures, rows = [F.count(F.lit(1)).alias("__n")], []
    for i, name in enumerate(columns):
        column = F.col(f"`{name}`")
        exact = isinstance(df.schema[name].dataType, (T.IntegralType, T.DecimalType))
        text = lambda bound, exact=exact: bound.cast("string") if exact else F.lit(None).cast("string")
        measures += [F.min(column).alias(f"lo{i}"), F.max(column).alias(f"hi{i}"),
                     F.count_if(column == 0).alias(f"z{i}"), F.count_if(column.isNull()).alias(f"e{i}")]
        rows.append(F.struct(F.lit(name).alias("column_name"), F.col(f"lo{i}").cast("double").alias("min_value"), F.col(f"hi{i}").cast("double").alias("max_value"),
                             text(F.col(f"lo{i}")).alias("exact_min"), text(F.col(f"hi{i}")).alias("exact_max"), F.col("__n").alias("total_count"), F.col(f"z{i}").alias("zero_count"), F.col(f"e{i}").alias("null_count")))
    return df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def string_profile(df: DataFrame, column: str) -> DataFrame:
    """Every distinct value with its count, and the total and null counts, as (finding, value, n)."""
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(
        F.struct(F.lit("total").alias("finding"), F.lit(None).cast("string").alias("value"), F.col("n")),
        F.struct(F.when(F.col("value").isNull(), F.lit("null")).otherwise(F.lit("value")).alias("finding"), F.col("value"), F.col("n")),
    )
    return _summed(counts.select(F.explode(rows).alias("r")).select("r.*"), ["finding", "value"])


def date_profile(df: DataFrame, column: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """One row of total, null, non-null and invalid counts with the first and last date of a text column."""
    text = F.col(f"`{column}`").cast("string")
    moment = parse_any(text, formats)
    read = df.select(text.alias("text"), moment.alias("moment"))
    return read.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("text").isNull()).alias("null_count"),
        F.count("text").alias("non_null_count"),
        F.min("moment").alias("min_date"),
        F.max("moment").alias("max_date"),
        F.count_if(F.col("text").isNotNull() & F.col("moment").isNull()).alias("invalid_date_count"),
    )


def invalid_dates(df: DataFrame, column: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Distinct values that no format reads."""
    text = F.col(f"`{column}`").cast("string")
    return df.filter(text.isNotNull() & parse_any(text, formats).isNull()).select(text.alias("value")).distinct()


def code_profile(df: DataFrame, column: str, codes: DataFrame, code_column: str, match: Normaliser = upper_code,
                 shown: Normaliser = trimmed, shown_invalid: Normaliser = as_is) -> DataFrame:
    """Value counts, the null count, and the values whose normalised form is not among ``codes``."""
    text = F.col(f"`{column}`").cast("string")
    counts = df.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = codes.select(match(F.col(f"`{code_column}`").cast("string")).alias("__code")).distinct()
    judged = counts.join(broadcast_if_small(known), match(F.col("value")) == F.col("__code"), "left_outer")
    value = F.col("value")
    rows = F.array_compact(F.array(
        F.when(value.isNull(), F.struct(F.lit("null").alias("finding"), value, F.col("n"))),
        F.when(value.isNotNull(), F.struct(F.lit("value").alias("finding"), shown(value).alias("value"), F.col("n"))),
        F.when(value.isNotNull() & F.col("__code").isNull(),
               F.struct(F.lit("invalid").alias("finding"), shown_invalid(value).alias("value"), F.col("n"))),
    ))
    return _summed(judged.select(F.explode(rows).alias("r")).select("r.*"), ["finding", "value"])


def country_profile(df: DataFrame, column: str, codes: DataFrame, code_column: str = "code") -> DataFrame:
    """Country codes, compared and shown trimmed and in upper case."""
    return code_profile(df, column, codes, code_column, upper_code, upper_code, upper_code)


def currency_profile(df: DataFrame, column: str, codes: DataFrame, code_column: str = "code") -> DataFrame:
    """Currency codes, compared in upper case; values shown trimmed, invalid ones as they are stored."""
    return code_profile(df, column, codes, code_column)


def unit_profile(df: DataFrame, column: str, units: DataFrame, unit_column: str = "unit") -> DataFrame:
    """Units of measure, compared in lower case and shown trimmed."""
    return code_profile(df, column, units, unit_column, lower_code, trimmed, trimmed)


def region_profile(df: DataFrame, country: str, region: str, pairs: DataFrame, pair_country: str = "country",
                   pair_region: str = "region") -> DataFrame:
    """Counts by (country, region), regions that no country has, and pairs that do not belong together. Only countries
    the reference knows are judged."""
    reference = _pairs(pairs, pair_country, pair_region, upper_code)
    counts = _pair_counts(df, country, region)
    group, value = F.col("group_value"), F.col("value")
    shared = F.broadcast if fits_broadcast(reference) else as_is  # its regions and countries are no larger
    regions = shared(reference.select(F.col("__value").alias("__region")).distinct())
    countries = shared(reference.select(F.col("__group").alias("__country")).distinct())
    judged = (counts.join(regions, upper_code(value) == F.col("__region"), "left_outer")
              .join(countries, upper_code(group) == F.col("__country"), "left_outer")
              .join(shared(reference), (upper_code(group) == F.col("__group")) & (upper_code(value) == F.col("__value")), "left_outer"))
    no_group = F.lit(None).cast("string")
    rows = F.array_compact(F.array(
        _finding("total", no_group, no_group),
        F.when(value.isNull(), _finding("null", no_group, no_group)),
        F.when(group.isNotNull() & value.isNotNull(), _finding("value", group, value)),
        F.when(value.isNotNull() & F.col("__region").isNull(), _finding("invalid", no_group, value)),
        F.when(value.isNotNull() & F.col("__country").isNotNull() & F.col("__value").isNull(), _finding("mismatch", group, value)),
    ))
    return _summed(judged.select(F.explode(rows).alias("r")).select("r.*"), ["finding", "group_value", "value"])


def postal_profile(df: DataFrame, country: str, postal: str, pairs: DataFrame, pair_country: str = "country",
                   pair_postal: str = "postal") -> DataFrame:
    """Counts by (country, postal code) and the pairs the reference lacks; an unknown country makes its codes mismatches."""
    reference = _pairs(pairs, pair_country, pair_postal, upper_code)
    counts = _pair_counts(df, country, postal)
    group, value = F.col("group_value"), F.col("value")
    judged = counts.join(broadcast_if_small(reference), (upper_code(group) == F.col("__group")) & (upper_code(value) == F.col("__value")), "left_outer")
    no_group, both = F.lit(None).cast("string"), group.isNotNull() & value.isNotNull()
    rows = F.array_compact(F.array(
        _finding("total", no_group, no_group),
        F.when(value.isNull(), _finding("null", no_group, no_group)),
        F.when(both, _finding("value", group, value)),
        F.when(both & F.col("__value").isNull(), _finding("mismatch", group, value)),
    ))
    return _summed(judged.select(F.explode(rows).alias("r")).select("r.*"), ["finding", "group_value", "value"])


def _finding(name: str, group: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("finding"), group.alias("group_value"), value.alias("value"), F.col("n"))


def _pair_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(F.col(f"`{group}`").cast("string").alias("group_value"), F.col(f"`{value}`").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def _pairs(pairs: DataFrame, group: str, value: str, match: Normaliser) -> DataFrame:
    """Distinct normalised pairs."""
    named = pairs.select(match(F.col(f"`{group}`").cast("string")).alias("__group"), match(F.col(f"`{value}`").cast("string")).alias("__value"))
    return named.distinct()


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").cast("bigint").alias("n"))
