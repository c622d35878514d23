"""Window functions from a configuration, with a plan for groups too large for one task.

Spark evaluates a window one group per task. Here the groups are counted first; groups within ``GROUP_ROWS`` take
Spark's own window, larger ones (and windows without PARTITION BY) are cut into pieces by a range partitioning on the
group and order columns. A piece is evaluated on its own and corrected by what the pieces before it hold, which is one
small row per group and piece.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import GROUP_ROWS, broadcast_if_small, fits_broadcast, hot_groups, join_null_safe, stage

PIECE, PLACE, TIE = "__piece", "__place", "__tie"
PIECE_ROWS = 50_000  # fewer rows are not worth a piece of their own
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's index within its partition in the low 33 bits

RANKS = ("ROW_NUMBER", "RANK", "DENSE_RANK")
SHIFTS = ("LAG", "LEAD")
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count,
}


class WindowError(ValueError):
    """A window configuration that cannot be built."""


def _named(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _order(spec: Mapping[str, Any]) -> list[Column]:
    keys = [(o["column"], str(o.get("direction", "ASC")).upper()) for o in spec.get("order_by", [])]
    return [F.col(f"`{c}`").desc_nulls_first() if d == "DESC" else F.col(f"`{c}`").asc_nulls_last() for c, d in keys]


def window(df: DataFrame, spec: Mapping[str, Any], hot_rows: int | None = GROUP_ROWS) -> DataFrame:
    """Add ``alias`` for ``{"function", "partition_by", "order_by": [{"column", "direction"}], "alias"}``.

    LAG and LEAD also take ``column``, ``offset`` and ``default``; NTILE takes ``buckets``; aggregates take ``column`` and,
    when ordered, run up to the current row and its peers, or with ``frame`` = (n, m) over the rows from n before to m after the
    current one. ``hot_rows=None`` skips the count of the groups; it is for inputs whose groups are known to be small.
    """
    function, keys = str(spec["function"]).upper(), list(spec.get("partition_by", []))
    order, alias = _order(spec), spec.get("alias", "window_result")
    if not order and (function not in AGGREGATES or spec.get("frame") is not None):
        raise WindowError(f"{function} needs order_by")
    if spec.get("frame") is not None and (function not in AGGREGATES or min(spec["frame"]) < 0):
        raise WindowError("a frame is for aggregates and counts rows before and after the current one")
    if hot_rows is None:
        return df.withColumn(alias, _plain(spec, function, keys, order))
    if not keys:
        return _split(df, spec, function, keys, order, alias, df.count(), hot_rows)
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(alias, _plain(spec, function, keys, order))
    total = hot.agg(F.sum("n_rows")).first()[0]
    marked = broadcast_if_small(hot.select(_named(keys)))
    normal = join_null_safe(df, marked, keys, "left_anti")
    large = join_null_safe(df, marked, keys, "left_semi")
    plain = normal.withColumn(alias, _plain(spec, function, keys, order))
    return plain.unionByName(_split(large, spec, function, keys, order, alias, total, hot_rows))


def _plain(spec: Mapping[str, Any], function: str, keys: list[str], order: list[Column]) -> Column:
    """Spark's own window expression."""
    over = Window.partitionBy(*_named(keys)).orderBy(*order)
    if function in RANKS:
        return {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[function]().over(over).cast("bigint")
    if function == "NTILE":
        return F.ntile(int(spec["buckets"])).over(over).cast("bigint")
    if function in SHIFTS:
        shift = F.lag if function == "LAG" else F.lead
        return shift(F.col(f"`{spec['column']}`"), int(spec.get("offset", 1)), spec.get("default")).over(over)
    if function in AGGREGATES:
        before, after = spec["frame"] if spec.get("frame") is not None else (None, None)
        return _measure(spec, function).over(over if before is None else over.rowsBetween(-int(before), int(after)))
    raise WindowError(f"unknown window function: {function}")


def _measure(spec: Mapping[str, Any], function: str) -> Column:
    return AGGREGATES[function](F.col(f"`{spec['column']}`") if spec.get("column") else F.lit(1))


def _split(df: DataFrame, spec: Mapping[str, Any], function: str, keys: list[str], order: list[Column], alias: str,
           total: int, hot_rows: int) -> DataFrame:
    if function in AGGREGATES and not order:
        return _whole_group(df, spec, function, keys, alias)
    if spec.get("frame") is not None:
        before, after = (int(n) for n in spec["frame"])
        return _with_halo(_numbered(df, keys, order, total, hot_rows), keys, before, after, hot_rows, lambda over: _measure(spec, function).over(over.rowsBetween(-before, after)), alias)
    if function in AGGREGATES or function in ("RANK", "DENSE_RANK"):
        return _by_peers(df, spec, function, keys, order, alias, total, hot_rows)
    placed = _numbered(df, keys, order, total, hot_rows)
    if function == "ROW_NUMBER":
        return placed.withColumnRenamed(PLACE, alias)
    if function == "NTILE":
        return _ntile(placed, keys, int(spec["buckets"])).withColumnRenamed(PLACE, alias)
    offset = int(spec.get("offset", 1)) * (1 if function == "LAG" else -1)
    shift = lambda over: F.lag(F.col(f"`{spec['column']}`"), offset, spec.get("default")).over(over)
    return _with_halo(placed, keys, max(offset, 0), max(-offset, 0), hot_rows, shift, alias)


def _parts(df: DataFrame, total: int, hot_rows: int) -> int:
    """Number of pieces: the session's parallelism where there is work for it, and more where pieces would be too large. A piece is a task,
    so beyond that parallelism none is cut below PIECE_ROWS, however small ``hot_rows`` is."""
    default, full = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PIECE_ROWS)
    return max(1, min(default, full), min(-(-4 * total // hot_rows), max(default, full)))


def _numbered(df: DataFrame, keys: list[str], order: list[Column], total: int, hot_rows: int) -> DataFrame:
    """``df`` with the row number within its group as PLACE, at the cost of one range shuffle and one staged copy.

    Ties are spread by a hash of the row's place in the input, so that a piece stays small even where all rows are alike.
    """
    tied = df.withColumn(TIE, F.xxhash64(F.monotonically_increasing_id()))
    sort_by = [*_named(keys), *order, F.col(TIE)]
    ranged = tied.repartitionByRange(_parts(df, total, hot_rows), *sort_by).sortWithinPartitions(*sort_by).drop(TIE)
    return _places(ranged, keys)


def _places(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """Row number within the group, in the order the rows have now: index within the piece plus the pieces before."""
    columns = _named(ranged.columns)
    staged = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "window")
    piece, local = F.shiftright("__at", LOCAL_BITS), F.col("__at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    rows = staged.select(*columns, piece.alias(PIECE), local.alias("__local"))
    sizes = rows.groupBy(*_named(keys), PIECE).agg(F.count(F.lit(1)).alias("__n"), F.min("__local").alias("__first"))
    before = F.coalesce(F.sum("__n").over(_earlier_pieces(keys)), F.lit(0))
    carry = broadcast_if_small(stage(sizes.withColumn("__before", before).drop("__n"), "carry"))
    place = (F.col("__before") + F.col("__local") - F.col("__first") + 1).alias(PLACE)
    return join_null_safe(rows, carry, [*keys, PIECE], "inner").select(*columns, place)


def _earlier_pieces(keys: Sequence[str]) -> Any:
    """Window over the one-row-per-group-and-piece table: the pieces of the group before this one."""
    return Window.partitionBy(*_named(keys)).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, order: Sequence[Column], name: str, hot_rows: int = GROUP_ROWS) -> DataFrame:
    """Add the 1-based position of every row in the total order, without gaps and without a single-task sort."""
    return _numbered(df, [], list(order), df.count(), hot_rows).withColumnRenamed(PLACE, name)


def with_read_order(df: DataFrame, name: str) -> DataFrame:
    """Add the 1-based position of every row as the files were read, without a shuffle."""
    return _places(df, []).withColumnRenamed(PLACE, name)


def _ntile(placed: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    sizes = placed.groupBy(*_named(keys)).agg(F.count(F.lit(1)).alias("__size"))
    sized = join_null_safe(placed, broadcast_if_small(stage(sizes, "sizes")), keys, "inner") if keys else placed.crossJoin(F.broadcast(sizes))
    small, extra = F.expr(f"__size div {buckets}"), F.col("__size") % buckets
    in_larger = F.col(PLACE) <= extra * (small + 1)
    tile = F.when(in_larger, F.ceil(F.col(PLACE) / (small + 1))).otherwise(
        extra + F.ceil((F.col(PLACE) - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return sized.withColumn(PLACE, tile.cast("bigint")).drop("__size")


def _with_halo(placed: DataFrame, keys: list[str], before: int, after: int, hot_rows: int, measure: Callable[[Any], Column], alias: str) -> DataFrame:
    """``measure`` over windows that reach ``before`` rows back and ``after`` rows ahead of a row's PLACE in its group.

    Groups are cut into pieces of consecutive places, and the rows near a border are copied to the pieces whose frames reach them: a halo. A task
    holds a piece and its halo, and a row is copied as often as pieces are in its reach, which is about once where frames are
    shorter than pieces.
    """
    size = max(1, min(PIECE_ROWS, hot_rows), before + after)
    piece = lambda place: F.floor(place / size).cast("bigint")
    reached = F.sequence(F.greatest(piece(F.col(PLACE) - 1 - after), F.lit(0).cast("bigint")), piece(F.col(PLACE) - 1 + before))
    copied = placed.withColumn(PIECE, F.explode(reached))
    over = Window.partitionBy(*_named(keys), PIECE).orderBy(PLACE)
    measured = copied.withColumn(alias, measure(over)).filter(F.col(PIECE) == piece(F.col(PLACE) - 1))
    return measured.drop(PLACE, PIECE)


def _whole_group(df: DataFrame, spec: Mapping[str, Any], function: str, keys: list[str], alias: str) -> DataFrame:
    """Aggregate over the whole group: aggregated partially, then joined to the rows."""
    result = df.groupBy(*_named(keys)).agg(_measure(spec, function).alias(alias))
    if not keys:
        return df.crossJoin(F.broadcast(result))
    return join_null_safe(df, broadcast_if_small(stage(result, "groups")), keys, "inner")


def _by_peers(df: DataFrame, spec: Mapping[str, Any], function: str, keys: list[str], order: list[Column], alias: str,
              total: int, hot_rows: int) -> DataFrame:
    """RANK, DENSE_RANK and running aggregates: equal for all rows with the same group and order values, so computed on
    one row per such set of peers and joined back. Many equal rows collapse before the shuffle."""
    by = [o["column"] for o in spec["order_by"]]
    columns = list(dict.fromkeys([*keys, *by]))
    value = F.col(f"`{spec['column']}`") if spec.get("column") else F.lit(1)
    kind = df.select(_plain(spec, function, keys, order).alias(alias)).schema[alias].dataType
    summed = _sum_type(df.select(value.alias("v")).schema["v"].dataType)
    peers = df.groupBy(*_named(columns)).agg(
        F.count(F.lit(1)).alias("__rows"), F.count(value).alias("__count"),
        *([F.sum(value.cast(summed)).cast(summed).alias("__sum")] if function in ("SUM", "AVG") else []),
        *([AGGREGATES[function](value).alias("__end")] if function in ("MIN", "MAX") else []))
    ranged = peers.repartitionByRange(_parts(df, total, hot_rows), *_named(keys), *order)
    staged = copy = stage(ranged.withColumn(PIECE, F.spark_partition_id()), "window")
    upto = Window.partitionBy(*_named(keys), PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = staged.groupBy(*_named(keys), PIECE)

    def running(measure: str, how: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
        return both(how(F.col(measure)).over(upto), F.col(f"__before{measure}"))

    def carried(measure: str, how: Callable[[Column], Column]) -> DataFrame:
        totals = pieces.agg(how(F.col(measure)).alias(measure))
        if measure == "__sum":
            totals = totals.withColumn(measure, F.col(measure).cast(summed))
        before = how(F.col(measure)).over(_earlier_pieces(keys))
        return broadcast_if_small(stage(totals.select(*_named(keys), PIECE, before.alias(f"__before{measure}")), "carry"))

    def plus(a: Column, b: Column) -> Column:
        return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(a + b)

    def with_carry(frame: DataFrame, measure: str, how: Callable[[Column], Column]) -> DataFrame:
        return join_null_safe(frame, carried(measure, how), [*keys, PIECE], "inner")

    if function == "DENSE_RANK":
        staged = staged.withColumn("__rows", F.lit(1).cast("bigint"))
        pieces = staged.groupBy(*_named(keys), PIECE)
    if function in ("RANK", "DENSE_RANK"):
        frame = with_carry(staged, "__rows", F.sum)
        done = frame.withColumn(alias, running("__rows", F.sum, plus) - F.col("__rows") + 1)
    elif function == "COUNT":
        done = with_carry(staged, "__count", F.sum).withColumn(alias, running("__count", F.sum, plus))
    elif function == "SUM":
        done = with_carry(staged, "__sum", F.sum).withColumn(alias, running("__sum", F.sum, plus).cast(kind))
    elif function == "AVG":
        frame = with_carry(with_carry(staged, "__sum", F.sum), "__count", F.sum)
        total = running("__sum", F.sum, plus).cast(T.DoubleType() if isinstance(kind, T.DoubleType) else summed)
        done = frame.withColumn(alias, F.try_divide(total, running("__count", F.sum, plus)).cast(kind))
    else:
        how, both = (F.min, F.least) if function == "MIN" else (F.max, F.greatest)
        done = with_carry(staged, "__end", how).withColumn(alias, running("__end", how, both))
    ranked = done.select(*_named(columns), F.col(f"`{alias}`"))
    return join_null_safe(df, F.broadcast(ranked) if fits_broadcast(copy) else ranked, columns, "inner")


def _sum_type(kind: T.DataType) -> T.DataType:
    """A type in which the pieces' sums of such values are exact and have room to grow; the result is cast to the window's own type."""
    if isinstance(kind, T.IntegralType):
        return T.DecimalType(38, 0)
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(min(38, kind.precision + 10), kind.scale)
    return T.DoubleType()


def window_expression(df: DataFrame, expression: str, alias: str) -> DataFrame:
    """Add a free ``f() OVER (...)`` SQL expression; filters on it belong above. Spark evaluates one group per task here, so ``window`` is the
    form for groups without a known bound: it has running and ROWS frames, and what is computed from its result is a column as any other."""
    return df.withColumn(alias, F.expr(expression))
