"""A node-and-edge specification folded into lazily built DataFrames.

``{"nodes": [{"id", "type", "config"}], "edges": [{"source", "target", "targetHandle"?}]}``. Each node becomes a DataFrame over its
parents' DataFrames and Catalyst sees the flow as one plan. Building it runs small jobs where a side or the groups of a
join, window or grouped step have to be measured, and writes what several branches must see alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from tablemill.ingest.cleaning import clean
from tablemill.operators import ordering
from tablemill.operators.aggregates import aggregate
from tablemill.operators.compute import compute_batches, compute_frame, compute_grouped
from tablemill.operators.filters import apply_filter
from tablemill.operators.joins import join
from tablemill.operators.projection import calculate, computed, project
from tablemill.operators.windows import window
from tablemill.quality.rules import rule
from tablemill.session import stage
from tablemill.sinks.tables import destination_rows, existing, upserted, write_table
from tablemill.sources.jdbc import where_limit
from tablemill.types import to_sink_types

Source = DataFrame | Callable[[Mapping[str, Any]], DataFrame]


class GraphError(ValueError):
    """A specification that is not a valid flow."""


# How many inputs a node type takes (None: two or more).
INPUTS: dict[str, int | None] = {
    "source": 0, "filter": 1, "projection": 1, "calculated": 1, "compute": 1, "aggregate": 1, "aggregation": 1, "window": 1,
    "sort": 1, "limit": 1, "distinct": 1, "clean": 1, "validate": 1, "map": 1, "join": 2, "union": None, "destination": 1,
}


def _source(config: Mapping[str, Any], sources: Mapping[str, Source]) -> DataFrame:
    name = config.get("table")
    if name not in sources:
        raise GraphError(f"unknown source table: {name}")
    found = sources[name]
    df = found if isinstance(found, DataFrame) else found(config)
    return where_limit(df, config.get("whereClause"), config.get("limit"))


def _compute(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    if config.get("columns"):
        return computed(df, config["columns"])
    if config.get("keys"):
        return compute_grouped(df, config["keys"], config["function"], config["schema"], config.get("merge"))
    if config.get("schema"):
        return compute_batches(df, config["function"], config["schema"])
    return compute_frame(df, config["function"])


def _valid_rows(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    for spec in config.get("rules", []):
        df = df.filter(rule(spec))
    return df


UNARY: dict[str, Callable[[DataFrame, Mapping[str, Any]], DataFrame]] = {
    "filter": lambda df, c: apply_filter(df, c.get("filter", c if "conditions" in c or "expression" in c else None), c.get("combine", "grouped")),
    "projection": project,
    "map": project,
    "calculated": lambda df, c: calculate(df, c["columns"]),
    "compute": _compute,
    "aggregate": aggregate,
    "aggregation": aggregate,
    "window": lambda df, c: window(df, c),
    "sort": lambda df, c: ordering.sort(df, c["keys"]),
    "limit": lambda df, c: df.limit(c["rows"]),
    "distinct": lambda df, c: ordering.distinct_rows(df, c.get("rowNumber")),
    "clean": clean,
    "validate": _valid_rows,
    "destination": lambda df, c: destination_rows(df, c.get("businessNames")) if c.get("businessNames") is not None else to_sink_types(df),
}


def _order(nodes: Mapping[str, Mapping[str, Any]], parents: Mapping[str, list[str]]) -> list[str]:
    """Node ids with every node after its parents; a cycle is an error."""
    done: dict[str, None] = {}
    while len(done) < len(nodes):
        ready = [n for n in nodes if n not in done and all(p in done for p in parents[n])]
        if not ready:
            raise GraphError(f"cycle among {sorted(n for n in nodes if n not in done)}")
        done.update(dict.fromkeys(ready))
    return list(done)


def _inputs(spec: Mapping[str, Any], nodes: Mapping[str, Mapping[str, Any]]) -> dict[str, list[str]]:
    """Parent ids per node, left before right for joins; checks ends, types and input counts."""
    parents: dict[str, list[tuple[int, str]]] = {n: [] for n in nodes}
    for position, edge in enumerate(spec.get("edges", [])):
        if edge["source"] not in nodes or edge["target"] not in nodes:
            raise GraphError(f"edge with an unknown end: {edge}")
        handle = {"left": -2, "right": -1}.get(str(edge.get("targetHandle", "")).lower(), position)
        parents[edge["target"]].append((handle, edge["source"]))
    for name, node in nodes.items():
        if node["type"] not in INPUTS:
            raise GraphError(f"unknown node type: {node['type']}")
        expected, given = INPUTS[node["type"]], len(parents[name])
        if (expected is None and given < 2) or (expected is not None and given != expected):
            raise GraphError(f"{name} ({node['type']}) takes {expected if expected is not None else 'two or more'} inputs, has {given}")
    if not any(node["type"] == "source" for node in nodes.values()):
        raise GraphError("no source node")
    return {n: [p for _, p in sorted(found, key=lambda f: f[0])] for n, found in parents.items()}


def build(spec: Mapping[str, Any], sources: Mapping[str, Source], share: str = "plan") -> dict[str, DataFrame]:
    """DataFrame per node id.

    A node with several children is by default planned once per child, so each branch prunes its own columns and rows
    down to the scan. ``share="stage"`` writes such a node to the shared folder instead; use it for slow sources. A node whose
    rows may differ from run to run (below a limit, a random value or user code) is written in either case, so that its branches
    agree; a row order it had is not kept for its children.
    """
    nodes = {n["id"]: n for n in spec["nodes"]}
    parents = _inputs(spec, nodes)
    children = {n: sum(n in p for p in parents.values()) for n in nodes}
    frames: dict[str, DataFrame] = {}
    forks = any(n > 1 for n in children.values())
    volatile: dict[str, bool] = {}
    for name in _order(nodes, parents):
        kind, config = nodes[name]["type"], nodes[name].get("config", {})
        inputs = [frames[p] for p in parents[name]]
        if kind == "source":
            df = _source(config, sources)
        elif kind == "join":
            df = join(*inputs, conditions=config.get("conditions", ()), join_type=config.get("joinType", "INNER"),
                      output_columns=config.get("outputColumns", ()), where=config.get("where"), split_hot=config.get("splitHot"))
        elif kind == "union":
            df = ordering.union(inputs, config.get("distinct", False))
        else:
            df = UNARY[kind](inputs[0], config)
        volatile[name] = forks and (any(volatile[p] for p in parents[name]) or _varies(kind, config, inputs, df))
        shared = children[name] > 1 and (share == "stage" or volatile[name])
        frames[name] = stage(df, name) if shared else df
        volatile[name] = volatile[name] and not shared
    return frames


def _varies(kind: str, config: Mapping[str, Any], inputs: list[DataFrame], df: DataFrame) -> bool:
    """Whether a node can give other rows when it runs again, its inputs being the same."""
    if kind in ("limit", "compute") or (kind == "source" and config.get("limit") is not None):
        return True
    if kind in ("calculated", "filter", "projection", "map", "validate"):
        nothing = inputs[0].sparkSession.createDataFrame([], inputs[0].schema)
        return not _deterministic(UNARY[kind](nothing, config))
    return kind == "source" and not _deterministic(df)


def _deterministic(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().deterministic()


def run(spec: Mapping[str, Any], sources: Mapping[str, Source], share: str = "plan") -> dict[str, DataFrame]:
    """DataFrames of the destination nodes, or of the nodes without children where there is no destination.

    Destinations have the sink's types and names. One with a ``path`` is written there by its ``loadMode`` (insert, replace, drop_and_reload or
    upsert, the last with ``keyColumns`` and optionally ``orderBy``), and the frame returned is the table read back.
    """
    frames = build(spec, sources, share)
    sinks = {n["id"]: n.get("config", {}) for n in spec["nodes"] if n["type"] == "destination"}
    leaves = [n for n in frames if n not in {e["source"] for e in spec.get("edges", [])}]
    return {n: _load(frames[n], sinks[n]) if n in sinks and sinks[n].get("path") else frames[n] for n in sinks or leaves}


def _load(df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    path, mode = config["path"], str(config.get("loadMode", "insert")).lower()
    table = existing(df.sparkSession, path) if mode == "upsert" else None
    if mode == "upsert" and not config.get("keyColumns"):
        raise GraphError("an upsert needs keyColumns")
    if table is not None:
        df, mode = upserted(table, df, config["keyColumns"], config.get("orderBy")), "replace"
    write_table(df, path, "insert" if mode == "upsert" else mode, config.get("onMismatch", "raise"))
    return df.sparkSession.read.parquet(path)


def preview(spec: Mapping[str, Any], sources: Mapping[str, Source], node: str, rows: int = ordering.PREVIEW_ROWS) -> DataFrame:
    """The first rows of any node."""
    frames = build(spec, sources)
    if node not in frames:
        raise GraphError(f"no node {node}")
    return ordering.preview(frames[node], rows)
