"""Writing destination tables: load modes, destination names and types, checked appends and upserts.

A mode that rewrites rows returns the new content; it is written to a path of its own, never over the one being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.ingest.cleaning import plain_number
from tablemill.ingest.inference import date_formats
from tablemill.ingest.moments import parse, parse_any
from tablemill.operators.ordering import distinct_rows
from tablemill.operators.windows import with_position
from tablemill.session import broadcast_if_small, stage
from tablemill.types import family, is_moment, to_sink_types

ID_COLUMN, ACTIVE_COLUMN = "__id", "__active"
RESERVED = ("__id", "__active", "is_active", "id")
LOAD_MODES = ("insert", "replace", "drop_and_reload")


class SinkError(ValueError):
    """A write that does not fit its destination."""


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def columns_differ(table: DataFrame, required: DataFrame) -> bool:
    """Whether a table's column names are not those required, order aside."""
    return set(table.columns) != set(required.columns)


def write_table(df: DataFrame, path: str, mode: str = "insert", on_mismatch: str = "raise") -> None:
    """Write ``df`` by load mode. ``insert`` creates or appends, ``replace`` keeps the table's types and exchanges its rows,
    ``drop_and_reload`` creates it anew. Columns that differ are an error and nothing is written; only with
    ``on_mismatch="recreate"`` the table is created anew and its rows go."""
    if on_mismatch not in ("raise", "recreate"):
        raise SinkError(f"on_mismatch is raise or recreate, not {on_mismatch}")
    if mode not in LOAD_MODES:
        raise SinkError(f"unknown load mode {mode}, use one of {LOAD_MODES}; for upserts see upserted()")
    table = None if mode == "drop_and_reload" else existing(df.sparkSession, path)
    if table is not None and columns_differ(table, df):
        if on_mismatch == "raise":
            raise SinkError(f"columns differ: table {table.columns}, rows {df.columns}")
        table, mode = None, "drop_and_reload"
    aligned = df if table is None else df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields])
    if mode == "insert":
        aligned.write.mode("append").parquet(path)
    else:
        # computed in full before the old rows go: a failing query leaves the table as it is, and it may read the table itself
        stage(aligned, "rows").write.mode("overwrite").parquet(path)


def write_branches(parent: DataFrame, destinations: Mapping[str, Any]) -> None:
    """Several destinations from one parent: ``{path: function of the parent}``. The parent is written once to the shared
    folder and each destination reads it from there."""
    shared = stage(parent, "parent")
    for path, branch in destinations.items():
        write_table(branch(shared), path)


def latest_updates(schema: T.StructType, updates: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """One update per key with the table's columns and types: the one with the largest ``order_by`` (null before all others, equal ones by a
    hash of the row); without it several updates of a key are an error at run time."""
    changes = updates.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
                             + ([F.col(f"`{order_by}`").alias("__order")] if order_by else []))
    rest = [c for c in schema.names if c not in keys]
    row = F.struct([F.col(f"`{c}`") for c in rest] or [F.lit(None).alias("__none")])
    if order_by:
        last = F.max_by(row, F.struct(F.col("__order").isNotNull(), F.col("__order"), F.xxhash64(row)))
    else:
        repeated = F.raise_error(F.lit("a key is updated twice; name the column that orders the updates"))
        last = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.any_value(row))
    latest = changes.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(last.alias("__row"))
    return latest.select([F.col(f"`{c}`") if c in keys else F.col("__row").getField(c).alias(c) for c in schema.names])


def upserted(table: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Content after an upsert: rows of ``table`` whose key is not updated, and the updates, reduced once to one per key (see ``latest_updates``).
    The whole table is written anew from it; ``versioned.commit_upsert`` rewrites only the files that hold an updated key."""
    latest = stage(latest_updates(table.schema, updates, keys, order_by), "updates")
    kept = table.join(broadcast_if_small(latest.select(*keys)), list(keys), "left_anti")
    return kept.select(table.columns).unionByName(latest)


def business_names(names: Sequence[str], labels: Mapping[str, str]) -> dict[str, str]:
    """Destination name per column: its label or its own name; a repeated one gets ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    result = {}
    for name in names:
        label = labels.get(name) or name
        seen[label] = seen.get(label, 0) + 1
        result[name] = label if seen[label] == 1 else f"{label}_{seen[label]}"
    return result


def with_business_names(df: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Rename to destination names, from ``labels`` or from the ``business_name`` in the columns' metadata."""
    known = labels if labels is not None else {f.name: f.metadata.get("business_name", "") for f in df.schema.fields}
    target = business_names(df.columns, known)
    return df.select([F.col(f"`{c}`").alias(target[c]) for c in df.columns])


def destination_rows(df: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Rows as a destination stores them: business names and destination types."""
    return with_business_names(to_sink_types(df), labels)


def with_system_columns(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Add ``__id`` in front and ``__active`` at the end. With ``order_by`` ids count 1, 2, 3 in that order; without it
    they are unique but not dense, and cost no shuffle."""
    taken = [c for c in df.columns if c.strip().lower() in RESERVED]
    if taken:
        raise SinkError(f"reserved column names: {taken}")
    if order_by:
        numbered = with_position(df, [F.col(f"`{c}`").asc_nulls_last() for c in order_by], ID_COLUMN)
    else:
        numbered = df.withColumn(ID_COLUMN, F.monotonically_increasing_id() + 1)
    return numbered.select(F.col(ID_COLUMN), *[F.col(f"`{c}`") for c in df.columns], F.lit(True).alias(ACTIVE_COLUMN))


def with_dense_ids(files: DataFrame) -> DataFrame:
    """Add ``__id`` in front and ``__active`` at the end, ids counting 1, 2, 3 through the files in the order of their names and through each
    file's rows. ``files`` is a plain reading of Parquet files: no shuffle and no copy, only a count per file comes first.

    Rows that a filter left out would make gaps and are an error; other frames take ``with_system_columns``."""
    taken = [c for c in files.columns if c.strip().lower() in RESERVED]
    if taken:
        raise SinkError(f"reserved column names: {taken}")
    sizes = files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.row_index").alias("last")).orderBy("file").collect()
    if any(r["n"] != r["last"] + 1 for r in sizes):
        raise SinkError("dense ids need whole files, these are filtered")
    ends = list(accumulate((r["n"] for r in sizes), initial=0))  # a row per file
    starts = files.sparkSession.createDataFrame([(r["file"], start) for r, start in zip(sizes, ends, strict=False)], "__file string, __start bigint")
    located = files.select(*[F.col(f"`{c}`") for c in files.columns], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    numbered = located.join(broadcast_if_small(starts), "__file")
    return numbered.select((F.col("__start") + F.col("__row") + 1).alias(ID_COLUMN), *[F.col(f"`{c}`") for c in files.columns], F.lit(True).alias(ACTIVE_COLUMN))


@dataclass(frozen=True)
class CheckedRows:
    """Typed rows that fit the table, the rejects as (row_number, first_column_value, column_name, value), and (rows, fit) as one row."""

    good: DataFrame
    rejects: DataFrame
    counts: DataFrame


def check_rows(rows: DataFrame, schema: T.StructType, row_number: str) -> CheckedRows:
    """Cast text rows to a table's types. File and table need the same columns, case and system columns aside.

    A date column is read by the one format that most of its values have (see ``date_formats``), or by any known format where no
    format prevails; values it does not read become null. Scientific notation is written out for numbers; any other value
    that does not cast rejects its row. The checked rows are written once, so that what is good and what is rejected
    come from the same reading of the source. ``row_number`` is the row's position in the input.
    """
    fields = [f for f in schema.fields if f.name not in (ID_COLUMN, ACTIVE_COLUMN)]
    given = {c.lower(): c for c in rows.columns if c != row_number}
    wanted = {f.name.lower() for f in fields}
    missing, extra = sorted(wanted - set(given)), sorted(set(given) - wanted)
    if missing or extra:
        raise SinkError(f"columns do not match: missing in file {missing}, not in table {extra}")
    raw = {f.name: F.col(f"`{given[f.name.lower()]}`") for f in fields}
    typed = [(f, f"__typed_{i}") for i, f in enumerate(fields)]
    dates = [given[f.name.lower()] for f in fields if family(f.dataType) == "DATE"]
    formats = {r["column_name"]: r["date_format"] for r in date_formats(rows, dates).collect()} if dates else {}
    cast = rows.select(F.col(f"`{row_number}`").alias("row_number"), raw[fields[0].name].alias("first_column_value"),
                       *[raw[f.name].alias(f"__raw_{i}") for i, f in enumerate(fields)],
                       *[_cast_text(raw[f.name], f.dataType, formats.get(given[f.name.lower()])).alias(name) for f, name in typed])
    failed = [F.when(F.col(f"__raw_{i}").isNotNull() & F.col(name).isNull(), F.struct(F.lit(f.name).alias("column_name"), F.col(f"__raw_{i}").alias("value")))
              for i, (f, name) in enumerate(typed) if family(f.dataType) != "DATE"]
    found = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<struct<column_name:string,value:string>>")
    checked = stage(cast.withColumn("__failed", found).drop(*[f"__raw_{i}" for i in range(len(fields))]), "checked")
    good = checked.filter(F.size("__failed") == 0).select("row_number", *[F.col(name).alias(f.name) for f, name in typed])
    rejects = checked.select("row_number", "first_column_value", F.explode("__failed").alias("f")).select("row_number", "first_column_value", "f.*")
    counts = checked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("__failed") == 0).alias("fit"))
    return CheckedRows(good, rejects, counts)


def _cast_text(text: Column, kind: T.DataType, date_format: str | None = None) -> Column:
    if family(kind) == "DATE":
        moment = parse(F.trim(text), date_format) if date_format else parse_any(F.trim(text))
        return moment.cast(kind) if is_moment(kind) else moment.cast("date")
    if family(kind) == "INTEGER":
        return plain_number(text).try_cast(kind)
    if family(kind) == "DECIMAL":
        return plain_number(text, "decimal").try_cast(kind)
    return text.try_cast(kind)


def without_blank_and_repeated(rows: DataFrame, row_number: str) -> DataFrame:
    """``rows`` without those that are blank in every column and without repeats of an earlier row; row numbers stay what they were."""
    others = [c for c in rows.columns if c != row_number]
    filled = reduce(or_, [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(False)) for c in others])
    return distinct_rows(rows.filter(filled), row_number)


def append_checked(rows: DataFrame, path: str, row_number: str, log_path: str | None = None) -> DataFrame:
    """Append text rows to the table at ``path`` if every one fits, else append nothing. Returns the rejects, empty on success.

    Blank rows and repeated rows are removed first. New rows of a table with ``__id`` go on counting after its largest id, in the
    order of ``row_number``; ``__active`` is true. With ``log_path`` one row about the append is added to the table there:
    (logged_at, path, rows_read, rows_removed, rows_appended, rows_rejected).
    """
    table = existing(rows.sparkSession, path)
    if table is None:
        raise SinkError(f"no table at {path}")
    source = stage(rows, "append") if log_path else rows
    kept = without_blank_and_repeated(source, row_number)
    if any(family(f.dataType) == "DATE" for f in table.schema.fields):
        kept = stage(kept, "append")  # read for the formats and once more for the values
    checked = check_rows(kept, table.schema, row_number)
    found = checked.counts.first()
    accepted = found["rows"] == found["fit"]
    if accepted:
        good = checked.good
        if ID_COLUMN in table.columns:
            last = table.agg(F.max(ID_COLUMN)).first()[0] or 0
            good = with_position(good, [F.col("row_number")], ID_COLUMN).withColumn(ID_COLUMN, (F.col(ID_COLUMN) + last).cast(table.schema[ID_COLUMN].dataType))
        if ACTIVE_COLUMN in table.columns:
            good = good.withColumn(ACTIVE_COLUMN, F.lit(True))
        good.select([F.col(f"`{c}`") for c in table.columns]).write.mode("append").parquet(path)
    if log_path:
        read, refused = source.count(), found["rows"] - found["fit"]
        entry = rows.sparkSession.range(1).select(
            F.current_timestamp().alias("logged_at"), F.lit(path).alias("path"), F.lit(read).cast("bigint").alias("rows_read"),
            F.lit(read - found["rows"]).cast("bigint").alias("rows_removed"), F.lit(found["fit"] if accepted else 0).cast("bigint").alias("rows_appended"),
            F.lit(refused).cast("bigint").alias("rows_rejected"))
        entry.write.mode("append").parquet(log_path)
    return checked.rejects
