"""The scalar function catalogue: names of configurations mapped to Column builders.

Where Spark's function of the same name differs from the catalogue's meaning (PostgreSQL's), the builder follows the
catalogue: CONCAT skips nulls, LOG is base 10, division of two integers truncates, SUBSTRING may start before the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.patterns import java_date_pattern
from tablemill.types import as_text, is_integral, spark_type


class FunctionError(ValueError):
    """An unknown function or a wrong number of arguments."""


# Date pattern tokens -> Java date pattern tokens, longest first.
PATTERN_TOKENS = {
    "YYYY": "yyyy",
    "HH24": "HH",
    "HH12": "hh",
    "MON": "MMM",
    "YY": "yy",
    "MM": "MM",
    "DD": "dd",
    "HH": "hh",
    "MI": "mm",
    "SS": "ss",
    "MS": "SSS",
    "US": "SSSSSS",
    "AM": "a",
    "PM": "a",
}
UNITS = ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND")
CURRENT_VALUES = ("NOW", "CURRENT_DATE", "CURRENT_TIMESTAMP")


def java_pattern(pattern: str) -> str:
    """Java date pattern for a ``YYYY-MM-DD HH24:MI:SS`` pattern."""
    return java_date_pattern(pattern, PATTERN_TOKENS)


def plain(value: Any) -> Any:
    """The Python value behind a literal argument such as a unit or a pattern."""
    if isinstance(value, Column):
        raise FunctionError("this argument has to be a constant")
    return value


def column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def substring(text: Any, start: Any, length: Any = None) -> Column:
    """Characters from the 1-based ``start``; positions before the text count towards ``length`` but give nothing."""
    text, begin = as_text(column(text)), column(start).cast("int")
    first = F.greatest(begin, F.lit(1))
    if length is None:
        return F.substr(text, first)
    last = begin + column(length).cast("int")
    return F.substr(text, first, F.greatest(last - first, F.lit(0)))


def concat(*values: Any) -> Column:
    """All arguments as text, nulls skipped."""
    return F.concat(*[F.coalesce(as_text(column(v)), F.lit("")) for v in values])


def concat_operator(*values: Any) -> Column:
    """``a || b``: null if any argument is null."""
    return F.concat(*[as_text(column(v)) for v in values])


def divide(df: DataFrame, left: Column, right: Column) -> Column:
    """``left / right``; two integers divide to an integer, rounded towards zero."""
    kinds = [f.dataType for f in df.select(left.alias("a"), right.alias("b")).schema.fields]
    return F.call_function("div", left, right) if all(map(is_integral, kinds)) else left / right


def round_to(value: Any, digits: Any = 0) -> Column:
    return F.round(column(value), int(plain(digits)))


def extract(part: Any, moment: Any) -> Column:
    """Date part as a number; DOW counts from Sunday = 0."""
    name = str(plain(part)).upper()
    if name == "DOW":
        return (F.dayofweek(column(moment)) - 1).cast("double")
    return F.date_part(F.lit(name), column(moment)).cast("double")


def to_char(value: Any, pattern: Any) -> Column:
    """Dates by a date pattern; numbers by a digit pattern such as ``999,990.00``."""
    text = str(plain(pattern))
    if re.search(r"[09]", text):
        return F.to_char(column(value), F.lit(text))
    return F.date_format(column(value), java_pattern(text))


def to_date(text: Any, pattern: Any) -> Column:
    return F.to_date(column(text), java_pattern(str(plain(pattern))))


def to_number(text: Any, pattern: Any = None) -> Column:
    if pattern is None:
        return as_text(column(text)).cast("decimal(38,10)")
    return F.to_number(column(text), F.lit(str(plain(pattern))))


def _unit(name: Any) -> str:
    unit = str(plain(name)).upper().rstrip("S")
    if unit not in UNITS:
        raise FunctionError(f"unknown unit: {name}")
    return unit


def date_add(unit: Any, amount: Any, moment: Any) -> Column:
    return F.timestamp_add(_unit(unit), column(amount).cast("int"), column(moment))


def date_diff(unit: Any, start: Any, end: Any) -> Column:
    """Whole units from ``start`` to ``end``."""
    return F.timestamp_diff(_unit(unit), column(start), column(end))


def if_else(test: Any, then: Any, otherwise: Any) -> Column:
    return F.when(column(test), column(then)).otherwise(column(otherwise))


def case(branches: list[tuple[Any, Any]], otherwise: Any = None) -> Column:
    """CASE WHEN over (condition, value) pairs; text values are taken as they are."""
    chain = reduce(lambda c, b: c.when(column(b[0]), column(b[1])), branches[1:],
                   F.when(column(branches[0][0]), column(branches[0][1])))
    return chain if otherwise is None else chain.otherwise(column(otherwise))


def cast(value: Any, kind: Any) -> Column:
    """CAST; a value that does not fit raises, as in the catalogue's database."""
    return column(value).cast(spark_type(str(plain(kind))))


def _on_text(function: Callable[[Column], Column]) -> Callable[[Any], Column]:
    return lambda value: function(as_text(column(value)))


def _on_number(function: Callable[[Column], Column]) -> Callable[[Any], Column]:
    return lambda value: function(column(value))


# name -> (builder, fewest arguments, most arguments or None)
CATALOGUE: dict[str, tuple[Callable[..., Column], int, int | None]] = {
    "UPPER": (_on_text(F.upper), 1, 1),
    "LOWER": (_on_text(F.lower), 1, 1),
    "SUBSTRING": (substring, 2, 3),
    "SUBSTR": (substring, 2, 3),
    "CONCAT": (concat, 2, None),
    "LENGTH": (_on_text(F.length), 1, 1),
    "TRIM": (_on_text(F.trim), 1, 1),
    "LTRIM": (_on_text(F.ltrim), 1, 1),
    "RTRIM": (_on_text(F.rtrim), 1, 1),
    "REPLACE": (lambda s, old, new: F.replace(as_text(column(s)), column(old), column(new)), 3, 3),
    "ABS": (_on_number(F.abs), 1, 1),
    "ROUND": (round_to, 1, 2),
    "FLOOR": (_on_number(F.floor), 1, 1),
    "CEIL": (_on_number(F.ceil), 1, 1),
    "CEILING": (_on_number(F.ceil), 1, 1),
    "SQRT": (_on_number(F.sqrt), 1, 1),
    "POWER": (lambda x, y: F.pow(column(x), column(y)), 2, 2),
    "EXP": (_on_number(F.exp), 1, 1),
    "LN": (_on_number(F.ln), 1, 1),
    "LOG": (_on_number(F.log10), 1, 1),
    "MOD": (lambda x, y: column(x) % column(y), 2, 2),
    "NOW": (lambda: F.current_timestamp(), 0, 0),
    "CURRENT_DATE": (lambda: F.current_date(), 0, 0),
    "CURRENT_TIMESTAMP": (lambda: F.current_timestamp(), 0, 0),
    "EXTRACT": (extract, 2, 2),
    "DATE_PART": (extract, 2, 2),
    "DATE_TRUNC": (lambda unit, ts: F.date_trunc(str(plain(unit)), column(ts)).cast("timestamp_ntz"), 2, 2),
    "TO_DATE": (to_date, 2, 2),
    "TO_CHAR": (to_char, 2, 2),
    "TO_NUMBER": (to_number, 1, 2),
    "DATEADD": (date_add, 3, 3),
    "DATEDIFF": (date_diff, 3, 3),
    "YEAR": (_on_number(F.year), 1, 1),
    "MONTH": (_on_number(F.month), 1, 1),
    "DAY": (_on_number(F.day), 1, 1),
    "IF": (if_else, 3, 3),
    "COALESCE": (lambda *values: F.coalesce(*map(column, values)), 1, None),
    "NULLIF": (lambda a, b: F.nullif(column(a), column(b)), 2, 2),
    "CAST": (cast, 2, 2),
}
NULL_SAFE = ("UPPER", "LOWER", "CONCAT", "SUBSTRING", "SUBSTR")


def call(name: str, *arguments: Any) -> Column:
    """Catalogue function applied to Columns and constants, with the argument count checked."""
    entry = CATALOGUE.get(name.upper())
    if entry is None:
        raise FunctionError(f"unknown function: {name}")
    builder, fewest, most = entry
    if len(arguments) < fewest or (most is not None and len(arguments) > most):
        raise FunctionError(f"{name.upper()} takes {fewest} to {most or 'any number of'} arguments, not {len(arguments)}")
    return builder(*arguments)


def call_null_safe(name: str, *arguments: Any) -> Column:
    """As ``call``; for the text functions a null text argument counts as empty."""
    upper = name.upper()
    if upper not in NULL_SAFE:
        return call(name, *arguments)
    texts = len(arguments) if upper == "CONCAT" else 1
    safe = [F.coalesce(as_text(column(a)), F.lit("")) if i < texts else a for i, a in enumerate(arguments)]
    return call(name, *safe)


def from_spec(spec: Any, null_safe: bool = False) -> Column | Any:
    """Column for a nested call specification ``{"function", "arguments"}``, ``{"column"}``, ``{"value"}`` or a constant;
    constants stay Python values so that units and patterns can be given in place."""
    if not isinstance(spec, Mapping):
        return spec
    if "column" in spec:
        return F.col(f"`{spec['column']}`")
    if "function" in spec:
        apply = call_null_safe if null_safe or spec.get("nullSafe") else call
        return apply(spec["function"], *[from_spec(a, null_safe) for a in spec.get("arguments", [])])
    return spec.get("value")
