"""Joins of two DataFrames from a configuration.

Names both sides have come out as ``_L_name`` and ``_R_name``. NULL keys never match. Catalyst picks broadcast, shuffled
hash or sort-merge by size; what this module adds is a plan for keys that hold a large share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.filters import COMPARISONS, apply_filter, conjunction, predicate
from tablemill.operators.projection import LEFT_PREFIX, RIGHT_PREFIX
from tablemill.session import GROUP_ROWS, broadcast_if_small, fits_broadcast, hot_groups, stage

# Configured join type -> Spark join type.
JOIN_TYPES = {
    "INNER": "inner",
    "LEFT": "left_outer",
    "RIGHT": "right_outer",
    "FULL": "full_outer",
    "FULL OUTER": "full_outer",
    "CROSS": "cross",
}


class JoinError(ValueError):
    """A join configuration that cannot be built."""


def with_prefixes(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with clashing names prefixed and other names unchanged."""
    taken_l, taken_r = {c.lower() for c in left.columns}, {c.lower() for c in right.columns}

    def renamed(df: DataFrame, other: set[str], prefix: str) -> DataFrame:
        return df.select([F.col(f"`{c}`").alias(prefix + c if c.lower() in other else c) for c in df.columns])

    return renamed(left, taken_r, LEFT_PREFIX), renamed(right, taken_l, RIGHT_PREFIX)


def _side_name(name: str, df: DataFrame, prefix: str) -> str:
    for candidate in (prefix + name, name):
        if candidate in df.columns:
            return candidate
    raise JoinError(f"unknown join column: {name}")


def join(left: DataFrame, right: DataFrame, conditions: Sequence[Mapping[str, str]] = (), join_type: str = "INNER",
         output_columns: Sequence[Mapping[str, Any]] = (), where: Any = None, split_hot: bool | None = None,
         hot_rows: int = GROUP_ROWS) -> DataFrame:
    """Join by ``conditions`` (``leftColumn``, ``rightColumn``, ``operator`` = by default), all of them ANDed.

    An unknown join type means INNER; without conditions the join is a cross join. ``where`` filters the joined rows and
    stays above the join, so outer joins keep their meaning; Catalyst moves it down where that is legal. For
    ``split_hot`` see ``equi_join``.
    """
    kind = JOIN_TYPES.get(join_type.upper(), "inner")
    left, right = with_prefixes(left, right)
    pairs = [(_side_name(c["leftColumn"], left, LEFT_PREFIX), _side_name(c["rightColumn"], right, RIGHT_PREFIX),
              c.get("operator") or "=") for c in conditions]
    unknown = [op for _, _, op in pairs if op not in COMPARISONS]
    if unknown:
        raise JoinError(f"unknown join operators: {unknown}")
    if kind == "cross" or not pairs:
        joined = cross(left, right)
    elif all(op == "=" for _, _, op in pairs):
        joined = equi_join(left, right, [(a, b) for a, b, _ in pairs], kind, split_hot, hot_rows)
    elif (band := find_band(left, right, pairs)) is not None:
        joined = band_join(left, right, pairs, band, kind)
    else:
        joined = left.join(right, conjunction([COMPARISONS[op](F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b, op in pairs]), kind)
    if where:
        joined = joined.filter(predicate(where, joined)) if isinstance(where, Mapping) else apply_filter(joined, where)
    return choose_output(joined, output_columns) if output_columns else joined


@dataclass(frozen=True)
class Band:
    """A column of one side that lies between two columns of the other."""

    point: str
    low: str
    high: str
    point_left: bool


def find_band(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> Band | None:
    """The band among join conditions: a column bounded from below and from above by columns of the other side, all of them numbers or
    moments. None where there is none, or where an equality gives Spark a key to join on."""
    kinds = {c: f.dataType for side in (left, right) for c, f in zip(side.columns, side.schema.fields, strict=True)}
    above, below = (">=", ">"), ("<=", "<")
    if any(op == "=" for _, _, op in pairs):
        return None
    for point_left in (True, False):
        for point in dict.fromkeys(a if point_left else b for a, b, _ in pairs):
            bounds = [(b, op) if point_left else (a, _MIRRORED.get(op, op)) for a, b, op in pairs if (a if point_left else b) == point]
            low, high = next((c for c, op in bounds if op in above), None), next((c for c, op in bounds if op in below), None)
            if low and high and all(_placeable(kinds[c]) for c in (point, low, high)):
                return Band(point, low, high, point_left)
    return None


# A comparison with its sides exchanged.
_MIRRORED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}


def _placeable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _place(column: str, kind: T.DataType) -> Column:
    """A number that rises with the column: equal or larger for equal or larger values."""
    value = F.col(f"`{column}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        value = value.cast("timestamp")
    return value.cast("double")


#: Rows of a bin's points and of its spans that a task compares at once, where that leaves enough blocks; and at most.
BLOCK_ROWS = 8_192
MOST_BLOCK_ROWS = 1 << 18

#: Blocks for each core that crowded bins are cut into at least, if they have the pairs.
CORE_BLOCKS = 8


def band_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str, str]], band: Band, kind: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join on ``low <= point <= high`` (or strictly) and further comparisons, by bins instead of a nested loop.

    Intervals of a few neighbouring lengths share bins about as wide as they are, see ``_grids``. Points and intervals that share a bin
    are never far apart, so what is compared grows with the result. Bins only choose; the conditions themselves decide.
    Points and intervals are first cut to each other's range. Null ends and points match nothing.

    Bins are counted: those without points or without intervals go, and those of many pairs are cut into blocks, each
    point meeting each interval in one of them. Blocks are as large as it takes for their rows to grow with the input, though their pairs
    grow with its square. They are sorted and merged, never broadcast. Outer joins add the rows without a match. Those are found by their compared
    values, each combination once, in joins that stop at the first match, so the pairs themselves are only passed on.
    """
    if kind != "inner":  # read again for the rows without a match, and rows may vary
        left, right = stage(left, "left"), stage(right, "right")
    tests = [COMPARISONS[op](F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b, op in pairs]
    meeting = conjunction([*[F.col(f"__l_{c}") == F.col(f"__r_{c}") for c in _BLOCK], *tests])

    def sides(left: DataFrame, right: DataFrame) -> list[DataFrame]:
        blocks = _blocks(left, right, band, block_rows) if band.point_left else _blocks(right, left, band, block_rows)[::-1]
        return [side.withColumnsRenamed({f"__{c}": f"__{name}_{c}" for c in _BLOCK}) for side, name in zip(blocks, "lr", strict=True)]

    one, other = sides(left, right)
    result = one.join(other.hint("merge"), meeting, "inner").select([F.col(f"`{c}`") for c in (*left.columns, *right.columns)])
    if kind == "inner":
        return result
    compared = [list(dict.fromkeys(names)) for names in ([a for a, _, _ in pairs], [b for _, b, _ in pairs])]
    values = [stage(_compared_values(side, names), "values") for side, names in ((left, compared[0]), (right, compared[1]))]
    one, other = sides(*values)
    for side, names, these, those, missing in ((left, compared[0], one, other, ("left_outer", "full_outer")), (right, compared[1], other, one, ("right_outer", "full_outer"))):
        if kind in missing:
            matched = these.join(those.hint("merge"), meeting, "left_semi").select([F.col(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(names)]).distinct()
            known = conjunction([F.col(f"`{c}`") == F.col(f"__m{i}") for i, c in enumerate(names)])
            result = result.unionByName(side.join(broadcast_if_small(stage(matched, "matched")), known, "left_anti").select(_columns_or_null(side, result)))
    return result


def _compared_values(side: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each combination of ``names`` once, without nulls, which match nothing."""
    values = [F.col(f"`{c}`") for c in names]
    return side.select(values).filter(conjunction([v.isNotNull() for v in values])).distinct()


_BLOCK = ("bin", "level", "point_part", "span_part")


def _blocks(points: DataFrame, spans: DataFrame, band: Band, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points and spans with the _BLOCK columns, a row for each block they stand in, and spread by them."""
    of_point, of_span = {f.name: f.dataType for f in points.schema.fields}, {f.name: f.dataType for f in spans.schema.fields}
    named = [[F.col(f"`{c}`") for c in side.columns] for side in (points, spans)]
    points = points.withColumn("__at", _place(band.point, of_point[band.point])).filter(F.col("__at").isNotNull())
    spans = spans.withColumns({"__low": _place(band.low, of_span[band.low]), "__high": _place(band.high, of_span[band.high])}).filter(F.col("__low") <= F.col("__high"))
    finite = F.when(F.abs("__at") < float("inf"), F.col("__at"))
    ends = points.agg(F.min(finite).alias("first"), F.max(finite).alias("last")).first()
    first, last = (ends["first"], ends["last"]) if ends["first"] is not None else (0.0, 0.0)
    finest = math.frexp(max(abs(first), abs(last), 1e-300))[1] - 50  # a bin's number stays an exact integer
    cut = lambda c: F.least(F.greatest(c, F.lit(first)), F.lit(last))
    below, above = (F.col("__high") >= first) | (F.col("__low") == -math.inf), (F.col("__low") <= last) | (F.col("__high") >= math.inf)
    spans = spans.filter(below & above)  # beyond the finite points only infinite ones can match
    reach = spans.agg(F.min("__low").alias("low"), F.max("__high").alias("high")).first()
    if reach["low"] is not None:
        points = points.filter((F.col("__at") >= F.lit(reach["low"])) & (F.col("__at") <= F.lit(reach["high"])))
    spans = spans.withColumns({"__low": cut(F.col("__low")), "__high": cut(F.col("__high"))})
    length = F.col("__high") - F.col("__low")
    spans = spans.withColumn("__length", F.greatest(F.lit(finest), F.coalesce(F.ceil(F.log2(length)), F.lit(finest))).cast("int"))
    lengths = [_Length(*r) for r in spans.groupBy("__length").agg(F.count(F.lit(1)), F.max(length)).sort("__length").collect()]  # at most as many as a number has exponents
    cores = points.sparkSession.sparkContext.defaultParallelism
    grids = _grids(lengths, points.count(), last - first, finest, block_rows, CORE_BLOCKS * cores)
    bin_of = lambda c, level: F.floor(c / F.pow(F.lit(2.0), F.lit(float(level)))).cast("bigint")
    cells = [F.when(F.col("__length").between(g.shortest, g.longest), F.struct(F.lit(g.shortest).alias("level"), F.sequence(bin_of(F.col("__low"), g.level), bin_of(F.col("__low" if g.before else "__high"), g.level)).alias("bins"))) for g in grids]
    none = F.struct(F.lit(finest).alias("level"), F.lit(None).cast("array<bigint>").alias("bins"))
    spans = spans.withColumn("__s", F.coalesce(*cells, none)).withColumns({"__level": F.col("__s.level"), "__bin": F.explode("__s.bins")})
    at = cut(F.col("__at"))
    bins = F.array(*[F.struct(F.lit(g.shortest).alias("level"), (bin_of(at, g.level) - n).alias("bin")) for g in grids for n in range(g.before + 1)] or [F.struct(F.lit(finest).alias("level"), F.lit(None).cast("bigint").alias("bin"))])
    points = points.withColumn("__b", F.explode(bins)).withColumns({"__level": F.col("__b.level"), "__bin": F.col("__b.bin")})
    counted = [side.groupBy("__level", "__bin").agg(F.count(F.lit(1)).alias(name)) for side, name in ((points, "__points"), (spans, "__spans"))]
    shared = stage(counted[0].join(counted[1].hint("merge"), ["__level", "__bin"]), "bins")
    pairs = F.col("__points").cast("double") * F.col("__spans")
    total = shared.agg(F.sum(pairs).alias("pairs"), F.max(pairs).alias("most"), F.sum(F.col("__points") + F.col("__spans")).alias("rows")).first()
    block = float(block_rows) ** 2
    if total["rows"]:  # blocks so large that cutting copies no more rows than there are, but enough of them for every core
        block = max(block, min((2 * total["pairs"] / total["rows"]) ** 2, total["pairs"] / (CORE_BLOCKS * cores)))
    few = F.ceil(F.least("__points", "__spans") / math.sqrt(block))  # the side with less rows is cut into pieces of a square block's rows, the other one as often as it takes
    parts = lambda name, other: F.greatest(F.when(pairs > block, F.when(F.col(name) <= F.col(other), few).otherwise(F.ceil(pairs / block / few))).otherwise(1), F.ceil(F.col(name) / max(block_rows, MOST_BLOCK_ROWS))).cast("int")
    known = shared.select("__level", "__bin", parts("__points", "__spans").alias("__point_parts"), parts("__spans", "__points").alias("__span_parts"))
    if every := fits_broadcast(shared):
        known = F.broadcast(known)
    else:  # the few bins that are cut
        known = broadcast_if_small(stage(known.filter("__point_parts > 1 or __span_parts > 1"), "crowded"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total["rows"] and total["most"] > block:  # blocks of long work are not many, so that they are spread thin
        tasks = max(tasks, 2 * CORE_BLOCKS * cores)
    sides = []
    for side, columns, own, met in ((points, named[0], "point", "span"), (spans, named[1], "span", "point")):
        row = F.xxhash64(F.monotonically_increasing_id())  # by row, so that equal rows spread too
        placed = side.select(*columns, "__level", "__bin", row.alias("__salt")).join(known, ["__level", "__bin"], "inner" if every else "left_outer")
        own_parts, met_parts = (F.coalesce(F.col(f"__{name}_parts"), F.lit(1)) for name in (own, met))
        placed = placed.withColumns({f"__{own}_part": F.pmod("__salt", own_parts).cast("int"), f"__{met}_part": F.explode(F.sequence(F.lit(0), met_parts - 1))})
        keys = [f"__{c}" for c in _BLOCK]
        sides.append(placed.select(*columns, *keys).repartition(tasks, *keys))
    return sides[0], sides[1]


@dataclass(frozen=True)
class _Length:
    """Spans whose length is 2 to the power of ``level`` at most: how many, and the longest one's length."""

    level: int
    rows: int
    most: float


@dataclass(frozen=True)
class _Grid:
    """Bins 2 to the power of ``level`` wide for spans of the lengths from ``shortest`` to ``longest``. With ``before``, a span goes to the bin of its low end
    and a point to its own bin and as many before it; else a span goes to every bin it meets and a point to its own."""

    shortest: int
    longest: int
    level: int
    before: int


def _grids(lengths: Sequence[_Length], points: int, extent: float, finest: int, block_rows: int, blocks: int) -> list[_Grid]:
    """The grids, one or more lengths each, that copy the fewest rows: bins finer than the spans save points that a grid of their own would take, and cuts of
    crowded bins. Never bins wider than the spans, so that what is compared grows with the result."""
    best: list[tuple[float, list[_Grid]]] = [(0.0, [])]
    for end in range(1, len(lengths) + 1):
        options = []
        for start in range(end - 1, -1, -1):
            some = lengths[start:end]
            if some[-1].level - some[0].level > _FINER:
                break
            for level in range(max(finest, some[0].level - _FINER), some[0].level + 1):
                bins = extent / 2.0**level + 1
                spans, met = sum(x.rows for x in some), sum(x.rows * min(x.most / 2.0**level + 1, bins) for x in some)
                before = int(max(x.most for x in some) / 2.0**level) + 1
                for copies, own, of_points in ((0, met, points), *[(before, spans, points * (before + 1))] * (before <= _BEFORE)):
                    cuts = max(1.0, min(blocks, own * of_points / bins / block_rows**2) / bins)
                    cost = max(own, of_points) + min(own, of_points) * cuts
                    options.append((best[start][0] + cost, -level, [*best[start][1], _Grid(some[0].level, some[-1].level, level, copies)]))
        cost, _, grids = min(options, key=lambda x: x[:2])
        best.append((cost, grids))
    return best[-1][1]


# Powers of two that bins are finer than spans at most, and bins before its own that a point goes to at most.
_FINER, _BEFORE = 10, 16


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows. A side measured as small is broadcast, so that the larger one is read once and not shuffled;
    with two large sides Spark pairs partitions."""
    if fits_broadcast(right):
        return left.crossJoin(F.broadcast(right))
    if fits_broadcast(left):
        return F.broadcast(left).crossJoin(right)
    return left.crossJoin(right)


def choose_output(joined: DataFrame, outputs: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Choose, order and rename joined columns: ``[{"column", "source": "left" | "right", "outputName"?, "included"?}]``."""
    chosen = []
    for item in outputs:
        if item.get("included") is False:
            continue
        prefix = {"left": LEFT_PREFIX, "right": RIGHT_PREFIX}.get(str(item.get("source", "")).lower(), "")
        name = next((c for c in (prefix + item["column"], item["column"]) if c in joined.columns), None)
        if name is None:
            raise JoinError(f"unknown output column: {item['column']}")
        chosen.append(F.col(f"`{name}`").alias(item.get("outputName") or item["column"]))
    return joined.select(chosen)


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], kind: str, split_hot: bool | None = None,
              hot_rows: int = GROUP_ROWS) -> DataFrame:
    """Equi join that no key can overload.

    Adaptive execution splits a hot key of an inner join, and one on the outer side of an outer join. It cannot split
    one on the other side, so that side's keys are counted first (``split_hot=None``); True counts both sides always,
    False never. Only if some key holds more than ``hot_rows`` rows is the join taken apart: matches come from an inner
    join in which hot keys carry a salt, and an outer join adds the rows whose key the other side lacks, found against
    the other side's distinct keys.
    """
    look_left = kind in ("right_outer", "full_outer") if split_hot is None else split_hot
    look_right = kind in ("left_outer", "full_outer") if split_hot is None else split_hot
    left_keys, right_keys = [a for a, _ in keys], [b for _, b in keys]
    hot_left = hot_groups(left.dropna(subset=left_keys), left_keys, hot_rows) if look_left else None
    hot_right = hot_groups(right.dropna(subset=right_keys), right_keys, hot_rows) if look_right else None
    on = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in keys]
    if hot_left is None and hot_right is None:
        return left.join(right, conjunction(on), kind)
    joined = _salted_inner(left, right, keys, hot_left, hot_right, hot_rows)
    if kind in ("left_outer", "full_outer"):
        joined = joined.unionByName(_unmatched(left, right, keys).select(_columns_or_null(left, joined)))
    if kind in ("right_outer", "full_outer"):
        joined = joined.unionByName(_unmatched(right, left, [(b, a) for a, b in keys]).select(_columns_or_null(right, joined)))
    return joined


def _columns_or_null(side: DataFrame, shape: DataFrame) -> list[Column]:
    """Columns of ``shape``: those ``side`` has as they are, the others as typed nulls."""
    return [F.col(f"`{f.name}`") if f.name in side.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in shape.schema.fields]


def _unmatched(side: DataFrame, other: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    known = other.select([F.col(f"`{b}`") for _, b in keys]).distinct()
    return side.join(known, conjunction([F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in keys]), "left_anti")


def _salted_inner(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], hot_left: DataFrame | None,
                  hot_right: DataFrame | None, hot_rows: int) -> DataFrame:
    left_keys, right_keys = [a for a, _ in keys], [b for _, b in keys]
    columns = [*left.columns, *right.columns]
    left, right = left.dropna(subset=left_keys), right.dropna(subset=right_keys)
    on = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in keys]
    if hot_left is not None:
        left, right = (_salt(left, left_keys, hot_left, hot_rows, "__l_salt", False),
                       _salt(right, right_keys, hot_left, hot_rows, "__l_copy", True))
        on.append(F.col("__l_salt") == F.col("__l_copy"))
    if hot_right is not None:
        right, left = (_salt(right, right_keys, hot_right, hot_rows, "__r_salt", False),
                       _salt(left, left_keys, hot_right, hot_rows, "__r_copy", True))
        on.append(F.col("__r_salt") == F.col("__r_copy"))
    return left.join(right, conjunction(on), "inner").select([F.col(f"`{c}`") for c in columns])


def _salt(side: DataFrame, keys: Sequence[str], hot: DataFrame, hot_rows: int, name: str, copies: bool) -> DataFrame:
    """Give rows of a hot key one of n salts, or one copy per salt on the side that has to meet all of them; n grows
    with the key's rows and is 1 for every other key."""
    parts = hot.select([F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(hot.columns[:-1])]
                       + [F.ceil(F.col("n_rows") / hot_rows).cast("int").alias("__parts")])
    on = conjunction([F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(keys)])
    row = F.xxhash64(F.monotonically_increasing_id())  # by row, so that equal rows spread too
    known = side.withColumn("__row", row).join(broadcast_if_small(parts), on, "left_outer")
    count = F.coalesce(F.col("__parts"), F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), count - 1)) if copies else F.pmod(F.col("__row"), count).cast("int")
    return known.withColumn(name, salt).select([*[F.col(f"`{c}`") for c in side.columns], name])
