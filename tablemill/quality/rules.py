"""Value rules: boolean Columns per rule, the violations as a long table and a summary, and checks of types and expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.ingest.moments import CHECKED_DATES, CHECKED_TIMESTAMPS, parse_any
from tablemill.types import family, spark_type

# Fixed values.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f")
TIME_24 = r"^([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d)?$"
TIME_12 = r"^(0?[1-9]|1[0-2]):[0-5]?\d(:[0-5]?\d)?\s+(AM|PM|am|pm)$"
JSON_START = r"^[\[{\"0-9tfn-]"
INTEGER_TYPES = ("integer", "bigint", "smallint", "serial", "bigserial", "int")
NUMBER_TYPES = ("numeric", "decimal", "real", "double precision", "float", "double")
TIMESTAMP_TYPES = ("timestamp", "timestamp without time zone", "timestamp with time zone")


class RuleError(ValueError):
    """An unknown rule or one without its parameters."""


def rule(spec: Mapping[str, Any]) -> Column:
    """True where ``{"column", "rule", ...parameters}`` holds. All rules but ``required`` accept null."""
    column, kind = F.col(f"`{spec['column']}`"), spec["rule"]
    text = column.cast("string")
    try:
        if kind == "required":
            return column.isNotNull() & (F.trim(text) != "")
        if kind == "min_length":
            test = F.length(text) >= spec["min"]
        elif kind == "max_length":
            test = F.length(text) <= spec["max"]
        elif kind == "regex":
            test = text.rlike(spec["pattern"])
        elif kind == "range":
            test = column.between(spec["min"], spec["max"])
        elif kind == "email":
            test = text.rlike(EMAIL)
        elif kind == "type":
            test = fits_type(text, spec["type"])
        else:
            raise RuleError(f"unknown rule: {kind}")
    except KeyError as missing:
        raise RuleError(f"{kind} needs the parameter {missing}") from None
    return F.coalesce(test, F.lit(True))


def rule_name(spec: Mapping[str, Any]) -> str:
    return f"{spec['column']}:{spec['rule']}"


def violations(df: DataFrame, rules: Sequence[Mapping[str, Any]], key: str) -> DataFrame:
    """One row (key, column_name, rule, value) per broken rule, in one pass and without a shuffle."""
    broken = [F.when(~rule(r), F.struct(F.lit(r["column"]).alias("column_name"), F.lit(r["rule"]).alias("rule"),
                                        F.col(f"`{r['column']}`").cast("string").alias("value"))) for r in rules]
    return df.select(F.col(f"`{key}`"), F.explode(F.array_compact(F.array(*broken))).alias("b")).select(f"`{key}`", "b.*")


def summary(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """(column_name, rule, checked, failed) per rule, in one aggregation over the table."""
    measured = df.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(~rule(r)).alias(f"f{i}") for i, r in enumerate(rules)])
    rows = [F.struct(F.lit(r["column"]).alias("column_name"), F.lit(r["rule"]).alias("rule"), F.col("checked"), F.col(f"f{i}").alias("failed"))
            for i, r in enumerate(rules)]
    return measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compose_pattern(parts: Sequence[str], last: str | None = None) -> str:
    """Pattern from chosen building blocks: start, the parts in order, then the last-character part or ``.+`` to the end."""
    return "^" + "".join(p for p in parts if p) + (last or ".+$")


def fits_type(text: Column, type_name: str) -> Column:
    """Whether text reads as a value of the named type; null stays null and text types accept everything."""
    kind, value = type_name.strip().lower(), F.trim(text)
    if kind in INTEGER_TYPES:
        return value.rlike(NUMBER) & (F.abs(value.try_cast("double")) < F.lit(float("inf")))
    if kind in NUMBER_TYPES:
        return value.rlike(NUMBER) | F.lower(value).rlike(r"^[+-]?(nan|inf|infinity)$")
    if kind == "boolean":
        return F.lower(value).isin(*BOOLEAN_WORDS)
    if kind == "date":
        return F.when(value.isNotNull(), parse_any(value, CHECKED_DATES).isNotNull())
    if kind in TIMESTAMP_TYPES:
        return F.when(value.isNotNull(), parse_any(value, CHECKED_TIMESTAMPS).isNotNull())
    if kind == "time":
        return value.rlike(TIME_24) | value.rlike(TIME_12)
    if kind == "uuid":
        bare = F.regexp_replace(F.lower(value), r"[{}-]|^(urn:uuid:|urn:|uuid:)", "")
        return bare.rlike(r"^[0-9a-f]{32}$")
    if kind in ("json", "jsonb"):
        return F.when(value.isNotNull(), F.coalesce(F.when(value.rlike(JSON_START), F.try_parse_json(value).isNotNull()), F.lit(False)))
    return F.when(text.isNotNull(), F.lit(True))


def check_expression(df: DataFrame, expression: str, expected: str | None = None) -> list[str]:
    """Problems of an expression over the columns of ``df``: syntax, unknown columns, argument counts and types as the
    analyser finds them, and a type family other than the expected one. No job runs."""
    return [message for _, message in _expression_problems(df, expression, expected)]


def _expression_problems(df: DataFrame, expression: str, expected: str | None) -> list[tuple[str, str]]:
    """Kind and message of each problem; the kind is the analyser's condition without its sub-condition, or TYPE."""
    try:
        kind = df.select(F.expr(expression).alias("value")).schema["value"].dataType
    except (AnalysisException, ParseException) as error:
        return [((error.getCondition() or "INVALID").split(".")[0], str(error).splitlines()[0])]
    if expected is None:
        return []
    wanted = df.sparkSession.createDataFrame([], f"value {spark_type(expected)}").schema["value"].dataType
    found = family(kind)
    agrees = found == family(wanted) or (family(wanted) == "DECIMAL" and found == "INTEGER")
    return [] if agrees else [("TYPE", f"the expression is {found}, expected {family(wanted)}")]


def valid_expressions(df: DataFrame, expressions: Mapping[str, tuple[str, str | None]]) -> tuple[DataFrame, DataFrame]:
    """``df`` with a column for every named (expression, expected type) without problems, in place of one of that name, and the
    problems of the others as rows (name, expression, kind, problem)."""
    found = {name: _expression_problems(df, text, expected) for name, (text, expected) in expressions.items()}
    rows = [(name, expressions[name][0], kind, problem) for name, problems in found.items() for kind, problem in problems]
    report = df.sparkSession.createDataFrame(rows, "name string, expression string, kind string, problem string")
    return df.withColumns({name: F.expr(text) for name, (text, _) in expressions.items() if not found[name]}), report
