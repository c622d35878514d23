"""Relational sources over JDBC: connection options per database kind and partitioned, pruned table scans."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values per database kind.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "oracle": "oracle.jdbc.OracleDriver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "hana": "com.sap.db.jdbc.Driver",
}
URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "hana": "jdbc:sap://{host}:{port}/?databaseName={database}",
}
PORTS = {"postgresql": 5432, "mysql": 3306, "oracle": 1521, "sqlserver": 1433, "hana": 30015}
QUOTES = {"postgresql": '""', "mysql": "``", "oracle": '""', "sqlserver": "[]", "hana": '""'}
FETCH_ROWS = 10_000
BATCH_ROWS = 10_000
SAMPLE_ROWS = 10


@dataclass(frozen=True)
class Connection:
    """Where a database is and how to log in; ``extra`` goes to the driver as it is."""

    kind: str
    host: str
    database: str
    user: str = ""
    password: str = field(default="", repr=False)
    port: int | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in DRIVERS:
            raise ValueError(f"unknown database kind: {self.kind}")

    def options(self) -> dict[str, str]:
        url = URLS[self.kind].format(host=self.host, port=self.port or PORTS[self.kind], database=self.database)
        return {"url": url, "driver": DRIVERS[self.kind], "user": self.user, "password": self.password, **self.extra}

    def table(self, name: str, schema: str | None = None) -> str:
        """Quoted table name; quote characters inside a name are doubled."""
        start, end = QUOTES[self.kind]

        def quoted(part: str) -> str:
            return start + part.replace(end, end * 2) + end

        return f"{quoted(schema)}.{quoted(name)}" if schema else quoted(name)


def read_options(connection: Connection, table: str, schema: str | None = None, fetch_rows: int = FETCH_ROWS) -> dict[str, str]:
    return {**connection.options(), "dbtable": connection.table(table, schema), "fetchsize": str(fetch_rows)}


def chunk_options(column: str, lower: object, upper: object, chunk_rows: int, total_rows: int, most: int = 10_000) -> dict[str, str]:
    """Partitioned read: ranges of ``column`` sized for about ``chunk_rows`` rows each, so executors read in parallel and a
    lost task reads its own range again. Rows outside the bounds belong to the first and last range; none is lost."""
    parts = max(1, min(most, -(-total_rows // chunk_rows)))
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}


def reader(spark: SparkSession, options: Mapping[str, str]) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options)


def read_table(spark: SparkSession, connection: Connection, table: str, schema: str | None = None, where: str | None = None,
               limit: int | None = None) -> DataFrame:
    """A table scan; Catalyst sends the filter, the limit and the pruned columns to the database."""
    return where_limit(reader(spark, read_options(connection, table, schema)).load(), where, limit)


def read_chunked(spark: SparkSession, connection: Connection, table: str, column: str, schema: str | None = None,
                 where: str | None = None, chunk_rows: int = FETCH_ROWS) -> DataFrame:
    """A table scan split by ranges of ``column``. Bounds and row count come from one aggregate that the database runs."""
    options = read_options(connection, table, schema, chunk_rows)
    whole = reader(spark, options).load()
    low, high, total = where_limit(whole, where).agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    if total == 0 or low is None:
        return where_limit(whole, where)
    return where_limit(reader(spark, {**options, **chunk_options(column, low, high, chunk_rows, total)}).load(), where)


def key_bounds(df: DataFrame, column: str, chunk_rows: int = FETCH_ROWS, most: int = 10_000) -> tuple[list[object], bool]:
    """Ascending bounds that cut the values of ``column``, a number or a moment, into ranges of about ``chunk_rows`` rows however they are
    distributed, and whether there are nulls. One aggregate with a sketch of bounded size; a bound is off by a tenth of a range at most, ``most`` ranges
    come out, and a value that holds more rows than a range is not cut."""
    kind = df.select(F.col(f"`{column}`")).schema[0].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"no ranges over {kind.simpleString()}: {column}")
    value = F.col(f"`{column}`")
    total, filled, low = df.agg(F.count(F.lit(1)), F.count(value), F.min(value)).first()
    parts = max(1, min(most, -(-filled // chunk_rows)))
    if parts == 1:
        return [], total > filled
    found = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0]
    return [bound for bound in dict.fromkeys(found) if bound > low and not (isinstance(bound, float) and not math.isfinite(bound))], total > filled


def sql_literal(value: object, kind: str | None = None) -> str:
    """A bound as SQL of a database kind."""
    if isinstance(value, dt.datetime):
        text = value.isoformat("T" if kind == "sqlserver" else " ", "microseconds" if value.microsecond else "seconds")
        return f"'{text}'" if kind == "sqlserver" else f"TIMESTAMP '{text}'"
    if isinstance(value, dt.date):
        return f"'{value.isoformat()}'" if kind == "sqlserver" else f"DATE '{value.isoformat()}'"
    if isinstance(value, Decimal):
        return format(value, "f")
    return repr(value)


def range_predicates(name: str, bounds: Sequence[object], nulls: bool, kind: str | None = None) -> list[str]:
    """One condition per range between ``bounds``; every row meets exactly one of them. ``name`` is the column as the database quotes it."""
    cuts = [sql_literal(b, kind) for b in bounds]
    ranges = [" AND ".join([f"{name} >= {low}"] * (low is not None) + [f"{name} < {high}"] * (high is not None))
              for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
    return [r or f"{name} IS NOT NULL" for r in ranges] + [f"{name} IS NULL"] * nulls


def read_by_keys(spark: SparkSession, connection: Connection, table: str, column: str, schema: str | None = None, where: str | None = None,
                 chunk_rows: int = FETCH_ROWS) -> DataFrame:
    """A table scan split where the values of ``column`` lie, so that gaps and dense stretches of a key give tasks of like size.

    The key column is read once before, in equal widths and with ``where`` applied. Rows that change their key meanwhile are seen as by any
    scan of several connections: once, twice or not at all."""
    keys = read_chunked(spark, connection, table, column, schema, where, chunk_rows).select(F.col(f"`{column}`"))
    bounds, nulls = key_bounds(keys, column, chunk_rows)
    options = read_options(connection, table, schema, chunk_rows)
    url, name = options.pop("url"), options.pop("dbtable")
    predicates = range_predicates(connection.table(column), bounds, nulls, connection.kind)
    return where_limit(spark.read.jdbc(url, name, predicates=predicates, properties=options), where)


def where_limit(df: DataFrame, where: str | None = None, limit: int | None = None) -> DataFrame:
    """A source's own ``whereClause`` and ``limit``."""
    filtered = df.filter(F.expr(where)) if where else df
    return filtered.limit(limit) if limit is not None else filtered


def sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of a table, for a look at its columns."""
    return df.limit(rows)


def row_count(df: DataFrame, where: str | None = None) -> DataFrame:
    """COUNT(*) with an optional filter, as one row."""
    return where_limit(df, where).agg(F.count(F.lit(1)).alias("row_count"))


def mapping_rows(df: DataFrame) -> DataFrame:
    """Distinct (SYS_ID, MT_ID, COBJ_IDENT) combinations of a mapping table, sorted."""
    columns = ["SYS_ID", "MT_ID", "COBJ_IDENT"]
    return df.select(columns).distinct().orderBy(columns)


def project_objects(projects: DataFrame, headers: DataFrame, subprojects: DataFrame, objects: DataFrame, mappings: DataFrame) -> DataFrame:
    """Migration objects of staging projects that are not to be deleted: a project with its header, its subprojects, their
    objects where there are any, and their mapping headers."""
    live = projects.filter((F.col("APPROACH") == "STAGING") & (F.col("TO_BE_DELETED") != "X")).select("UUID")
    head = headers.select(F.col("GUID").alias("UUID"), "REF_CLIENT")
    sub = subprojects.select(F.col("PROJECT").alias("UUID"), F.col("GUID").alias("SPRJ_GUID"), F.col("IDENT").alias("SUBPROJECT"))
    parts = objects.select(F.col("SUBPROJECT").alias("SPRJ_GUID"), "SOURCE", "IDENT", "COBJ_ALIAS", "CONTENT_DATE", "CONTENT_TIME",
                           "AUTHOR", "CREATEDATE", F.col("GUID").alias("OBJ_GUID"))
    maps = mappings.select("SUBPROJECT", "ID", "DESCR", "IS_ACTIVE", "ACTIVE_PHASE")
    joined = live.join(head, "UUID").join(sub, "UUID").join(parts, "SPRJ_GUID", "left_outer").join(maps, "SUBPROJECT")
    return joined.select("ID", "SOURCE", "IDENT", "DESCR", "SUBPROJECT", "COBJ_ALIAS", "IS_ACTIVE", "REF_CLIENT", "ACTIVE_PHASE",
                         "CONTENT_DATE", "CONTENT_TIME", "AUTHOR", "CREATEDATE", "OBJ_GUID", "SPRJ_GUID")


def write_options(connection: Connection, table: str, schema: str | None = None, replace: bool = False, batch_rows: int = BATCH_ROWS,
                  partitions: int = 16) -> dict[str, str]:
    """Options of a bulk load: batched inserts over a bounded number of connections; ``replace`` keeps the table and
    truncates it."""
    options = {**connection.options(), "dbtable": connection.table(table, schema), "batchsize": str(batch_rows), "numPartitions": str(partitions)}
    return {**options, "truncate": "true"} if replace else options


def write_table(df: DataFrame, connection: Connection, table: str, schema: str | None = None, mode: str = "insert") -> None:
    """Load a table: ``insert`` appends, ``replace`` truncates first, ``drop_and_reload`` creates it anew."""
    save = {"insert": "append", "replace": "overwrite", "drop_and_reload": "overwrite"}[mode]
    df.write.format("jdbc").options(**write_options(connection, table, schema, mode == "replace")).mode(save).save()
