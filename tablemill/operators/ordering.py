"""Sorting, paging, distinct values, duplicate rows and union. Nulls sort last ascending and first descending."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.windows import with_position
from tablemill.session import stage

PREVIEW_ROWS, PREVIEW_LIMIT = 50, 100
PAGE_LIMIT = 1000
# Up to here a page is cut by a top-n heap per task; pages further down are found by position.
NEAR_ROWS = 10_000
# Rows of a range of a page index at least, and how many ranges an index has at most.
INDEX_ROWS, MOST_RANGES = 100_000, 10_000
TIE = "__tie"


def order_column(column: str, direction: str = "asc") -> Column:
    reference = F.col(f"`{column}`")
    return reference.desc_nulls_first() if direction.lower() == "desc" else reference.asc_nulls_last()


def order_columns(keys: Sequence[Mapping[str, str] | str]) -> list[Column]:
    return [order_column(k) if isinstance(k, str) else order_column(k["column"], k.get("direction", "asc")) for k in keys]


def sort(df: DataFrame, keys: Sequence[Mapping[str, str] | str]) -> DataFrame:
    """Total sort by one or more ``{"column", "direction"}`` keys. Equal keys are ordered by input partition, so that
    the range partitioning can cut a run of equal keys that would not fit one task."""
    return df.withColumn("__tie", F.spark_partition_id()).orderBy(*order_columns(keys), "__tie").drop("__tie")


def top_k(df: DataFrame, keys: Sequence[Mapping[str, str] | str], k: int) -> DataFrame:
    """First ``k`` rows of the sort; a heap per task, so the rows are never sorted as a whole."""
    return df.orderBy(*order_columns(keys)).limit(k)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """At most ``rows`` rows; asking for more than the preview limit is an error."""
    if not 0 <= rows <= PREVIEW_LIMIT:
        raise ValueError(f"a preview has at most {PREVIEW_LIMIT} rows")
    return df.limit(rows)


def page(df: DataFrame, keys: Sequence[Mapping[str, str] | str], number: int, size: int) -> DataFrame:
    """Rows of a 1-based page in the order of ``keys``; rows with equal keys are ordered by a hash of all columns, so that
    pages never repeat or miss a row.

    A page near the top is a limit over the sort, which Spark runs as a bounded heap per task. A page far down would make
    every task and the driver keep all rows above it, so it is cut by global row position instead.
    """
    if number < 1 or not 1 <= size <= PAGE_LIMIT:
        raise ValueError(f"page starts at 1 and page size is 1 to {PAGE_LIMIT}")
    return _cut(df, [*order_columns(keys), _tie(df)], (number - 1) * size, size)


def _tie(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _cut(df: DataFrame, order: Sequence[Column], skip: int, size: int) -> DataFrame:
    if skip + size <= NEAR_ROWS:
        return df.orderBy(*order).offset(skip).limit(size)
    placed = with_position(df, order, "__place")
    return placed.filter(F.col("__place").between(skip + 1, skip + size)).orderBy("__place").drop("__place")


def page_index(df: DataFrame, keys: Sequence[Mapping[str, str] | str], ranges: int | None = None) -> DataFrame:
    """Where the ranges of the order of ``keys`` begin, staged: (range, rows_before, n_rows, first values of the keys, __tie). A range is a run of
    consecutive rows in the order that ``page`` uses, ``INDEX_ROWS`` of them or more, and there are at most ``MOST_RANGES``.

    Only the order columns are shuffled, equal ones counted before, and the first of a range is found while its task reads it. The index holds as
    long as the rows of ``df`` do.
    """
    names = [k if isinstance(k, str) else k["column"] for k in keys]
    ties = df.select(*[F.col(f"`{n}`").alias(f"__key{i}") for i, n in enumerate(names)], _tie(df).alias(TIE))
    distinct = stage(ties.groupBy(*ties.columns).agg(F.count(F.lit(1)).alias("__n")), "order")
    if ranges is None:
        total = distinct.agg(F.sum("__n")).first()[0] or 0
        ranges = max(1, min(MOST_RANGES, -(-total // INDEX_ROWS)))
    named = [f"__key{i}" for i in range(len(names))]
    order = [*order_columns([n if isinstance(k, str) else {**k, "column": n} for n, k in zip(named, keys, strict=True)]), F.col(TIE)]
    sorted_ranges = distinct.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = T.StructType([T.StructField("range", T.IntegerType()), *[T.StructField(f.name, f.dataType, True) for f in distinct.schema.fields]])

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows = None, 0
        for batch in batches:
            if batch.num_rows:
                first = first if first is not None else batch.slice(0, 1)
                rows += pc.sum(batch.column(batch.num_columns - 1)).as_py()
        if first is not None:
            number = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([number, *first.columns[:-1], pa.array([rows], pa.int64())], ["range", *first.schema.names])

    firsts = stage(sorted_ranges.mapInArrow(first_rows, found).withColumnRenamed("__n", "n_rows"), "ranges")
    before = F.sum("n_rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # at most MOST_RANGES rows
    return stage(firsts.withColumn("rows_before", F.coalesce(before, F.lit(0)).cast("bigint")), "pages")


def indexed_page(df: DataFrame, index: DataFrame, keys: Sequence[Mapping[str, str] | str], number: int, size: int) -> DataFrame:
    """The rows that ``page`` gives, read from the ranges of ``page_index`` that hold them: bounds on the first key reach the scan, and only the rows
    of these ranges are sorted. ``keys`` have to be those of the index."""
    if number < 1 or not 1 <= size <= PAGE_LIMIT:
        raise ValueError(f"page starts at 1 and page size is 1 to {PAGE_LIMIT}")
    skip = (number - 1) * size
    held = index.filter((F.col("rows_before") < skip + size) & (F.col("rows_before") + F.col("n_rows") > skip)).orderBy("range").collect()
    if not held:
        return df.limit(0)
    after = index.filter(F.col("range") > held[-1]["range"]).orderBy("range").limit(1).collect()
    rows = df
    if held[0]["rows_before"]:
        rows = rows.filter(_within(held[0]["__key0"], keys[0], False)).filter(~_before(index, df, held[0], keys))
    for row in after:
        rows = rows.filter(_within(row["__key0"], keys[0], True)).filter(_before(index, df, row, keys))
    return _cut(rows, [*order_columns(keys), _tie(df)], skip - held[0]["rows_before"], size)


def _key(key: Mapping[str, str] | str) -> tuple[Column, bool]:
    """Column of a sort key, and whether it falls."""
    return (F.col(f"`{key}`"), False) if isinstance(key, str) else (F.col(f"`{key['column']}`"), key.get("direction", "asc").lower() == "desc")


def _within(value: Any, key: Mapping[str, str] | str, upper: bool) -> Column:
    """A test on the first sort key alone that a scan can push: true for all rows up to (``upper``) or from ``value`` on."""
    column, falling = _key(key)
    if value is None:  # nulls are first when falling and last when rising
        return column.isNull() if falling == upper else F.lit(True)
    test = column <= value if falling != upper else column >= value
    return column.isNull() | test if falling == upper else test


def _before(index: DataFrame, df: DataFrame, first: Row, keys: Sequence[Mapping[str, str] | str]) -> Column:
    """Whether a row comes before the row ``first`` of an index."""
    earlier, equal = F.lit(False), F.lit(True)
    for n, key in enumerate(keys):
        column, falling = _key(key)
        value = F.lit(first[f"__key{n}"]).cast(index.schema[f"__key{n}"].dataType)
        if first[f"__key{n}"] is None:
            less = F.lit(False) if falling else column.isNotNull()
        elif falling:
            less = column.isNull() | (column > value)
        else:
            less = F.coalesce(column < value, F.lit(False))
        earlier, equal = earlier | (equal & less), equal & column.eqNullSafe(value)
    return earlier | (equal & (_tie(df) < F.lit(first[TIE])))


def page_summary(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row about a page: total rows and pages, whether there is a next and a previous one, first and last row shown."""
    total, skip = F.col("total_count"), (number - 1) * size
    shown = total > skip
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        total,
        F.ceil(total / size).cast("bigint").alias("total_pages"),
        (total > skip + size).alias("has_next"),
        F.lit(number > 1).alias("has_previous"),
        F.when(shown, F.lit(skip + 1)).otherwise(F.lit(0)).cast("bigint").alias("showing_start"),
        F.when(shown, F.least(total, F.lit(skip + size))).otherwise(F.lit(0)).cast("bigint").alias("showing_end"),
    )


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-null values of a column as text, the first ``limit`` of them where the caller sets one."""
    values = df.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").isNotNull()).distinct()
    ordered = values.orderBy("value") if limit is None else values.orderBy("value").limit(limit)
    return ordered.select(F.col("value").cast("string").alias("value"))


def distinct_rows(df: DataFrame, row_number: str | None = None) -> DataFrame:
    """Rows without repeats. With ``row_number`` naming a column of input positions, repeats are judged on the other
    columns and the first position is kept: one aggregation, so many copies of a row collapse before the shuffle."""
    if row_number is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != row_number]
    first = F.min(F.col(f"`{row_number}`")).alias(row_number)
    return df.groupBy(*[F.col(f"`{c}`") for c in others]).agg(first).select(df.columns)


def union(frames: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """All rows of all frames, matched by name; a column that a frame lacks is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result.distinct() if distinct else result
