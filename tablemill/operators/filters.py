"""Filter specifications turned into Columns, and filters applied to DataFrames.

A condition is ``{"column", "operator", "value"}``; conditions nest under ``{"type": "logical", "operator": "AND" | "OR" |
"NOT", "expressions": [...]}`` or stand in a flat list whose items carry ``logicalOperator``. Values become literals of
the column's own type, so comparisons reach the scan as pushed filters.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import broadcast_if_small
from tablemill.operators.projection import LEFT_PREFIX, RIGHT_PREFIX
from tablemill.types import family, is_text

# Operators by the kind of value they take.
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}
TEXT_TESTS: dict[str, Callable[[Column, str], Column]] = {
    "LIKE": lambda c, v: c.like(f"%{v}%"),
    "ILIKE": lambda c, v: c.ilike(f"%{v}%"),
    "CONTAINS": lambda c, v: c.contains(v),
    "NOT_CONTAINS": lambda c, v: ~c.contains(v),
    "STARTS_WITH": lambda c, v: c.startswith(v),
    "ENDS_WITH": lambda c, v: c.endswith(v),
}
NULL_TESTS = ("IS NULL", "IS NOT NULL")
BOOLEAN_OPERATORS = ("=", "!=", "<>", *NULL_TESTS)
TRUE_WORDS = ("true", "1", "yes", "t")
FALSE_WORDS = ("false", "0", "no", "f")
DATE_TEXT = r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?"


class FilterError(ValueError):
    """A filter specification that cannot be turned into a predicate."""


def typed_value(value: Any, kind: T.DataType) -> Column:
    """Literal of the column's type for a configured value; text is parsed, and text that does not parse is an error."""
    if isinstance(value, str) and not is_text(kind):
        value = _parse_text(value.strip(), kind)
    if family(kind) == "INTEGER" and isinstance(value, int) and _beyond(value, T.LongType()):
        return F.lit(math.copysign(math.inf, value))  # beyond every integer, as infinity is
    literal = F.lit(value)
    if is_text(kind):
        return literal if isinstance(value, str) else literal.cast("string")
    if family(kind) == "INTEGER" and (isinstance(value, (float, Decimal)) or _beyond(value, kind)):
        return literal  # 24.5 or 3000000000 against an int column compares as a number
    if isinstance(kind, T.DateType) and _has_time(value):
        return literal.cast("timestamp_ntz")
    if family(kind) == "DECIMAL" and isinstance(value, Decimal):
        return literal.cast("double") if isinstance(kind, (T.DoubleType, T.FloatType)) else literal
    return literal.cast(kind)


def _beyond(value: Any, kind: T.DataType) -> bool:
    """Whether an integer has no room in an integer type."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
    return bits is not None and isinstance(value, int) and not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1)


def _has_time(value: Any) -> bool:
    return isinstance(value, str) and bool(re.search("[1-9]", value.strip()[10:]))


def _parse_text(text: str, kind: T.DataType) -> Any:
    group = family(kind)
    try:
        if group == "INTEGER":
            return int(text)
        if group == "DECIMAL":
            return Decimal(text)
    except (ValueError, InvalidOperation):
        raise FilterError(f"{text!r} is not a number") from None
    if group == "BOOLEAN":
        if text.lower() in TRUE_WORDS:
            return True
        if text.lower() in FALSE_WORDS:
            return False
        raise FilterError(f"{text!r} is not a boolean")
    if group == "DATE" and not re.fullmatch(DATE_TEXT, text):
        raise FilterError(f"{text!r} is not a date; use YYYY-MM-DD or YYYY-MM-DD HH:MM:SS")
    return text


def _value_list(value: Any) -> list[Any]:
    if isinstance(value, str):
        return [part.strip() for part in value.split(",") if part.strip()]
    if isinstance(value, Iterable) and not isinstance(value, dict):
        return list(value)
    return [value]


def _bounds(value: Any) -> tuple[Any, Any]:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            value = [part.strip() for part in value.split(",")]
    if isinstance(value, dict):
        value = [value.get("min", value.get("from")), value.get("max", value.get("to"))]
    if not isinstance(value, (list, tuple)) or len(value) != 2 or any(v is None or v == "" for v in value):
        raise FilterError("BETWEEN needs a lower and an upper bound")
    return value[0], value[1]


def column_name(name: str | None, df: DataFrame) -> str:
    """The column that a configured name means: its own name, or after ``left.``, ``right.`` or a table's name that of one side of
    a join (where both sides have it, the prefixed one)."""
    if name and name in df.columns:
        return name
    side, dot, rest = str(name).partition(".")
    prefix = {"left": LEFT_PREFIX, "right": RIGHT_PREFIX}.get(side.lower())
    for candidate in ([prefix + rest] if prefix else []) + [rest]:
        if dot and candidate in df.columns:
            return candidate
    raise FilterError(f"unknown column: {name}")


def mismatch(name: str, value: Any, df: DataFrame) -> Column:
    """``MISMATCH``: the column and the one other column of the pairs hold one of them. ``value`` is a list of objects or its JSON text."""
    try:
        pairs = json.loads(value) if isinstance(value, str) else value
    except ValueError:
        raise FilterError("MISMATCH needs a list of pairs or its JSON text") from None
    if not isinstance(pairs, list) or not pairs or not all(isinstance(p, dict) and name in p and len(p) == 2 for p in pairs):
        raise FilterError(f"MISMATCH needs pairs of {name} and one other column")
    others = {other for p in pairs for other in p if other != name}
    if len(others) != 1 or any(v is None for p in pairs for v in p.values()):
        raise FilterError("the pairs of MISMATCH have one other column and no nulls")
    related = others.pop()
    one, other = column_name(name, df), column_name(related, df)
    return disjunction([(F.col(f"`{one}`") == typed_value(p[name], df.schema[one].dataType)) & (F.col(f"`{other}`") == typed_value(p[related], df.schema[other].dataType)) for p in pairs])


def condition(spec: dict[str, Any], df: DataFrame) -> Column:
    """Predicate for one ``{"column", "operator", "value"}``."""
    operator, value = str(spec.get("operator", "=")).upper(), spec.get("value")
    name = column_name(spec.get("column"), df)
    if operator == "MISMATCH":
        return mismatch(spec["column"], value, df)
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType) and operator not in BOOLEAN_OPERATORS:
        raise FilterError(f"{operator} does not apply to the boolean column {name}")
    if operator == "IS NULL":
        return column.isNull()
    if operator == "IS NOT NULL":
        return column.isNotNull()
    if value is None or value == "":
        raise FilterError(f"{operator} needs a value; use IS NULL to look for missing ones")
    if isinstance(kind, T.DateType) and operator in ("<", "<=", ">", ">=") and _has_time(value):
        # a day lies before a moment inside day d exactly if it is d or earlier
        _parse_text(value.strip(), kind)
        return COMPARISONS["<=" if operator in ("<", "<=") else ">"](column, F.lit(value.strip()[:10]).cast(kind))
    if operator in COMPARISONS:
        return COMPARISONS[operator](column, typed_value(value, kind))
    if operator in TEXT_TESTS:
        return TEXT_TESTS[operator](column if is_text(kind) else column.cast("string"), str(value))
    if operator in ("IN", "NOT IN"):
        values = _value_list(value)
        if not values or any(v is None for v in values):
            raise FilterError(f"{operator} needs a list of values without nulls")
        inside = column.isin([typed_value(v, kind) for v in values])
        return inside if operator == "IN" else ~inside
    if operator == "BETWEEN":
        low, high = _bounds(value)
        return column.between(typed_value(low, kind), typed_value(high, kind))
    raise FilterError(f"unknown operator: {operator}")


def function_condition(spec: dict[str, Any], df: DataFrame) -> Column:
    """``UPPER(c) = v`` and ``LOWER(c) = v``: equality that ignores case."""
    function = str(spec.get("function", "")).upper()
    arguments = spec.get("arguments", [])
    if function not in ("UPPER", "LOWER") or len(arguments) != 1 or spec.get("operator", "=") != "=":
        raise FilterError("only UPPER(column) = value and LOWER(column) = value are function conditions")
    if not spec.get("value"):
        raise FilterError(f"{function} needs a value")
    return F.upper(F.col(f"`{column_name(arguments[0], df)}`").cast("string")) == F.upper(F.lit(str(spec["value"])))


def expression_condition(text: str, df: DataFrame) -> Column:
    """Free SQL text; it has to be boolean in the schema of ``df``."""
    predicate = F.expr(text)
    kind = df.select(predicate.alias("p")).schema["p"].dataType
    if not isinstance(kind, T.BooleanType):
        raise FilterError(f"the expression is {kind.simpleString()}, not boolean: {text}")
    return predicate


def conjunction(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def disjunction(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def logical(spec: dict[str, Any], df: DataFrame) -> Column:
    """Predicate for a nested AND / OR / NOT tree."""
    parts = [predicate(child, df) for child in spec.get("expressions", [])]
    if not parts:
        raise FilterError("a logical group needs at least one expression")
    operator = str(spec.get("operator", "AND")).upper()
    if operator == "AND":
        return conjunction(parts)
    if operator == "OR":
        return disjunction(parts)
    if operator == "NOT":
        return ~parts[0]
    raise FilterError(f"unknown logical operator: {operator}")


def combine(conditions: Sequence[dict[str, Any]], df: DataFrame, mode: str = "grouped") -> Column:
    """Predicate for a flat list whose items say how they attach to the one before.

    ``grouped``: all AND items form one group and all OR items another, ``(ANDs) OR (ORs)``; the first item is an AND.
    ``sequential``: as written, AND binding tighter than OR. ``all``: everything ANDed.
    """
    if not conditions:
        raise FilterError("no conditions")
    parts = [predicate(item, df) for item in conditions]
    links = ["AND"] + [str(item.get("logicalOperator") or "AND").upper() for item in conditions[1:]]
    if any(link not in ("AND", "OR") for link in links):
        raise FilterError(f"conditions are linked by AND or OR, not {links}")
    if mode == "all":
        return conjunction(parts)
    if mode == "grouped":
        return _by_group(parts, links)
    if mode == "sequential":
        return _in_order(parts, links)
    raise FilterError(f"unknown combination mode: {mode}")


def _by_group(parts: list[Column], links: list[str]) -> Column:
    required = [p for p, link in zip(parts, links) if link == "AND"]
    alternatives = [p for p, link in zip(parts, links) if link == "OR"]
    both = conjunction(required)
    return both | disjunction(alternatives) if alternatives else both


def _in_order(parts: list[Column], links: list[str]) -> Column:
    terms: list[list[Column]] = []
    for part, link in zip(parts, links):
        if link == "OR" or not terms:
            terms.append([part])
        else:
            terms[-1].append(part)
    return disjunction([conjunction(term) for term in terms])


def predicate(spec: dict[str, Any], df: DataFrame, mode: str = "grouped") -> Column:
    """Predicate for any form of specification."""
    if "conditions" in spec:
        return combine(spec["conditions"], df, spec.get("combine", mode))
    if spec.get("mode") == "expression" or spec.get("type") == "expression":
        return expression_condition(spec["expression"], df)
    kind = spec.get("type", "condition")
    if kind == "logical":
        return logical(spec, df)
    if kind == "function":
        return function_condition(spec, df)
    return condition(spec, df)


def apply_filter(df: DataFrame, spec: dict[str, Any] | Sequence[dict[str, Any]] | None, mode: str = "grouped") -> DataFrame:
    """Rows for which ``spec`` is true; an empty specification keeps every row."""
    if not spec or (isinstance(spec, dict) and spec.get("conditions") == []):
        return df
    if isinstance(spec, dict):
        return df.filter(predicate(spec, df, mode))
    return df.filter(combine(list(spec), df, mode))


def matching_pairs(df: DataFrame, column: str, related: str, pairs: DataFrame | Sequence[dict[str, Any]]) -> DataFrame:
    """Rows whose (column, related) is one of ``pairs``: a semi join, broadcast only if the pairs are few."""
    if not isinstance(pairs, DataFrame):
        schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in (column, related)])
        pairs = df.sparkSession.createDataFrame([(p[column], p[related]) for p in pairs], schema)
    wanted = pairs.select(F.col(f"`{column}`"), F.col(f"`{related}`")).dropna().distinct()
    return df.join(broadcast_if_small(wanted), [column, related], "left_semi").select(df.columns)


def branch_union(df: DataFrame, specs: Sequence[Any], mode: str = "grouped") -> DataFrame:
    """Rows that at least one branch of a shared source needs: the OR of the branch filters."""
    if not specs or any(not spec for spec in specs):
        return df
    return df.filter(disjunction([_branch(spec, df, mode) for spec in specs]))


def _branch(spec: Any, df: DataFrame, mode: str) -> Column:
    return predicate(spec, df, mode) if isinstance(spec, dict) else combine(list(spec), df, mode)


def tagged_branches(df: DataFrame, branches: Mapping[str, Any], tag: str = "branch", mode: str = "grouped") -> DataFrame:
    """Every row once per branch whose filter it meets, with the branch's name in ``tag``: one scan for all branches, and no shuffle.
    An empty filter takes every row."""
    met = [F.when(_branch(spec, df, mode) if spec else F.lit(True), F.lit(name)) for name, spec in branches.items()]
    shared = branch_union(df, list(branches.values()), mode)
    return shared.withColumn(tag, F.explode(F.array_compact(F.array(*met))))
