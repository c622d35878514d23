"""Grouped and global aggregation from a configuration.

Every function here aggregates partially before the shuffle, so a key that holds a large share of the rows reaches its
reducer as one partial row per input task. COUNT_DISTINCT first shuffles by (key, value), which splits such a key too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.filters import apply_filter

# Configured aggregate -> Spark aggregate.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.count_distinct,
    "STDDEV": F.stddev_samp,
    "VARIANCE": F.var_samp,
}
AUTO_GROUP = {"condition": "HAS_AGGREGATE", "action": "NON_AGG_COLUMNS_GROUP_BY"}


class AggregateError(ValueError):
    """An aggregate configuration that fails validation; ``problems`` lists every finding."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


def check(aggregates: Sequence[Mapping[str, Any]], columns: Sequence[str]) -> list[str]:
    """Problems of an aggregate list: known function, source column (COUNT may go without), alias, existing column."""
    problems = []
    for item in aggregates:
        function, source = str(item.get("function", "")).upper(), item.get("column") or ""
        if function not in FUNCTIONS:
            problems.append(f"unknown aggregate {function!r}, use one of {', '.join(FUNCTIONS)}")
        if not source and function != "COUNT":
            problems.append(f"{function} needs a source column")
        if source and source != "*" and source not in columns:
            problems.append(f"unknown source column {source!r}")
        if source == "*" and function != "COUNT":
            problems.append(f"{function}(*) does not exist")
        if not item.get("alias"):
            problems.append(f"{function} needs an alias")
    return problems


def default_alias(item: Mapping[str, Any]) -> str:
    source = item.get("column") or ""
    return f"{str(item['function']).upper()}_{source if source and source != '*' else 1}"


def aggregate_column(item: Mapping[str, Any]) -> Column:
    function, source = str(item["function"]).upper(), item.get("column") or ""
    if function == "COUNT" and source in ("", "*"):
        return F.count(F.lit(1)).alias(item["alias"])
    return FUNCTIONS[function](F.col(f"`{source}`")).alias(item["alias"])


def group_columns(spec: Mapping[str, Any], columns: Sequence[str]) -> list[str]:
    """Grouping columns in configuration order. With the auto-group rule every selected column that is not an aggregate;
    else ``selectedColumns``, else ``groupByColumns``, else the union of the aggregates' own ``groupBy`` lists."""
    aliases = {a.get("alias") for a in spec.get("aggregateColumns", [])}
    if AUTO_GROUP in [{k: r.get(k) for k in AUTO_GROUP} for r in spec.get("rules", [])]:
        return [c for c in spec.get("columns") or columns if c not in aliases]
    chosen = spec.get("selectedColumns") or spec.get("groupByColumns")
    if not chosen:
        chosen = [c for a in spec.get("aggregateColumns", []) for c in a.get("groupBy") or []]
    return [c for c in dict.fromkeys(chosen) if c not in aliases]


def _named(spec: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The aggregates of a configuration, each with an alias where it has a function."""
    items = [dict(a) for a in spec.get("aggregateColumns", [])]
    for item in items:
        if item.get("function") and not item.get("alias"):
            item["alias"] = default_alias(item)
    return items


def find_problems(df: DataFrame, spec: Mapping[str, Any], on_missing: str = "raise") -> list[str]:
    """Everything that keeps ``aggregate`` from running ``spec``; no job runs."""
    items = _named(spec)
    if not items:
        return []
    problems = check(items, df.columns)
    missing = [k for k in group_columns({**spec, "aggregateColumns": items}, df.columns) if k not in df.columns]
    if missing and on_missing != "drop":
        problems.append(f"unknown grouping columns: {', '.join(missing)}")
    return problems


def aggregate_valid(df: DataFrame, specs: Mapping[str, Mapping[str, Any]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Results of the named configurations that have no problem, and the problems of the others as rows (name, number, problem)."""
    found = {name: find_problems(df, spec) for name, spec in specs.items()}
    rows = [(name, number, problem) for name, problems in found.items() for number, problem in enumerate(problems, 1)]
    report = df.sparkSession.createDataFrame(rows, "name string, number int, problem string")
    return {name: aggregate(df, spec) for name, spec in specs.items() if not found[name]}, report


def aggregate(df: DataFrame, spec: Mapping[str, Any], on_missing: str = "raise") -> DataFrame:
    """Apply ``{"groupByColumns", "aggregateColumns": [{"function", "column", "alias"}], "filter"?, "having"?}``.

    ``filter`` applies before grouping and ``having`` to the output columns. No aggregates means the input unchanged, no
    grouping columns one row. Unknown grouping columns raise, or are left out with ``on_missing="drop"``.
    """
    items = _named(spec)
    if not items:
        return df
    problems = find_problems(df, spec, on_missing)
    keys = [k for k in group_columns({**spec, "aggregateColumns": items}, df.columns) if k in df.columns or on_missing != "drop"]
    if problems:
        raise AggregateError(problems)
    source = apply_filter(df, spec.get("filter"))
    measures = [aggregate_column(item) for item in items]
    result = source.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*measures) if keys else source.agg(*measures)
    return apply_filter(result, spec.get("having"), "all")
