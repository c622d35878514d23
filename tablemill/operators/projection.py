"""Column selection, renaming and calculated columns."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.scalars import column, from_spec
from tablemill.types import spark_type

LEFT_PREFIX, RIGHT_PREFIX = "_L_", "_R_"


class ProjectionError(ValueError):
    """A projection that cannot be built on the given columns."""


def unique(names: Sequence[str]) -> list[str]:
    """Names without repeats, first position kept."""
    return list(dict.fromkeys(names))


def resolve_name(name: str, columns: Sequence[str]) -> list[str]:
    """Columns a configured name stands for: itself, or after a join its ``_L_`` / ``_R_`` forms. The older spelling
    ``x_l`` / ``x_r`` is understood as well. Unknown names give an empty list."""
    if name in columns:
        return [name]
    prefixed = [p + name for p in (LEFT_PREFIX, RIGHT_PREFIX) if p + name in columns]
    if prefixed:
        return prefixed
    for suffix, prefix in (("_l", LEFT_PREFIX), ("_r", RIGHT_PREFIX)):
        if name.endswith(suffix) and prefix + name[: -len(suffix)] in columns:
            return [prefix + name[: -len(suffix)]]
    return []


def include(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named columns in the given order; unknown names are skipped, repeats kept once, and no valid name at all
    means every column."""
    kept = unique([found for name in names for found in resolve_name(name, df.columns)])
    return df.select([F.col(f"`{c}`") for c in kept]) if kept else df


def exclude(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def reorder(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Listed columns first in list order, the others after them as they were."""
    first = [c for c in unique(order) if c in df.columns]
    return df.select([F.col(f"`{c}`") for c in first + [c for c in df.columns if c not in first]])


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source to target column mapping: only mapped columns are kept, in mapping order."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ProjectionError(f"unknown columns: {missing}")
    return df.select([F.col(f"`{source}`").alias(target) for source, target in mapping.items()])


def expression(spec: str | Mapping[str, Any]) -> Column:
    """Column for a calculated expression: Spark SQL text, or a function call
    ``{"function": "CONCAT", "arguments": [{"column": "a"}, {"value": "-"}]}`` that keeps the catalogue's semantics."""
    return F.expr(spec) if isinstance(spec, str) else column(from_spec(spec))


def calculate(df: DataFrame, columns: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Add ``[{"name", "expression", "dataType"?}]``. They may refer to each other in any order.

    A name the input already has keeps the input's column, and the first of two equal names wins. Every round adds the columns that
    name no other column still waiting, and where there is none, all that resolve against the frame so far.
    """
    waiting: dict[str, Column] = {}
    words: dict[str, set[str]] = {}
    present = {c.lower() for c in df.columns}
    for spec in columns:
        name = spec["name"]
        if name.lower() in present or name.lower() in {n.lower() for n in waiting}:
            continue
        value = expression(spec["expression"])
        waiting[name] = value.cast(spark_type(spec["dataType"])) if spec.get("dataType") else value
        words[name] = _words(spec["expression"])
    while waiting:
        free = [n for n in waiting if not any(m.lower() in words[n] for m in waiting if m != n)]
        ready, problem = _resolved(df, {n: waiting[n] for n in free})
        if not ready:
            ready, problem = _resolved(df, waiting)
        if not ready:
            raise ProjectionError(f"cannot resolve {sorted(waiting)}: {problem}") from problem
        df = df.withColumns(ready)
        waiting = {n: v for n, v in waiting.items() if n not in ready}
    return df


def _words(spec: str | Mapping[str, Any]) -> set[str]:
    """Names an expression may refer to, in lower case: its words and back-quoted names outside of text literals."""
    text = re.sub(r"'(?:[^'\\]|\\.)*'", " ", spec) if isinstance(spec, str) else json.dumps(spec, default=str)
    return {w.lower() for found in re.findall(r"`([^`]+)`|\"([^\"]+)\"|(\w+)", text) for w in found if w}


def _resolved(df: DataFrame, columns: Mapping[str, Column]) -> tuple[dict[str, Column], AnalysisException | None]:
    """The columns that resolve against ``df`` by analysis alone, and the last problem of the others."""
    ready, problem = {}, None
    for name, value in columns.items():
        try:
            df.select(value.alias(name)).schema  # no job
            ready[name] = value
        except AnalysisException as error:
            problem = error
    return ready, problem


def computed(df: DataFrame, columns: Sequence[Mapping[str, str]]) -> DataFrame:
    """``SELECT *, expression AS alias`` for ``[{"alias", "expression"}]``, each over the input's own columns."""
    return df.select("*", *[expression(c["expression"]).alias(c["alias"]) for c in columns])


def project(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Apply a projection configuration: calculated columns, then include or exclude, then order."""
    if spec.get("calculatedColumns"):
        df = calculate(df, spec["calculatedColumns"])
    if spec.get("mapping"):
        return rename_map(df, spec["mapping"])
    if spec.get("selectedMode", "INCLUDE").upper() == "EXCLUDE":
        df = exclude(df, spec.get("excludedColumns", []))
    else:
        names = spec.get("selectedColumns") or spec.get("output_columns") or spec.get("includedColumns") or []
        if names and spec.get("calculatedColumns"):
            names = [*names, *[c["name"] for c in spec["calculatedColumns"]]]
        df = include(df, names)
    return reorder(df, spec["columnOrder"]) if spec.get("columnOrder") else df
