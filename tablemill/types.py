"""Names of column types as they appear in configurations, and their Spark types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Configuration type name -> Spark type.
SPARK_TYPES = {
    "STRING": "string",
    "TEXT": "string",
    "VARCHAR": "string",
    "CHAR": "string",
    "CHARACTER VARYING": "string",
    "UUID": "string",
    "JSON": "string",
    "JSONB": "string",
    "TIME": "string",
    "SMALLINT": "int",
    "INTEGER": "int",
    "INT": "int",
    "BIGINT": "bigint",
    "SERIAL": "bigint",
    "BIGSERIAL": "bigint",
    "REAL": "double",
    "FLOAT": "double",
    "DOUBLE": "double",
    "DOUBLE PRECISION": "double",
    "BOOLEAN": "boolean",
    "BOOL": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz",
    "TIMESTAMP WITHOUT TIME ZONE": "timestamp_ntz",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
    "BYTEA": "binary",
}
DECIMAL_NAMES = ("NUMERIC", "DECIMAL")


def spark_type(name: str) -> str:
    """Spark type for a configuration type name; ``NUMERIC(p,s)`` keeps its scale, bare NUMERIC gets ten decimals."""
    text = " ".join(name.strip().upper().split())
    base, _, size = text.partition("(")
    base = base.strip()
    if base in DECIMAL_NAMES:
        return f"decimal({size.rstrip(') ')})" if size else "decimal(38,10)"
    if base not in SPARK_TYPES:
        raise ValueError(f"unknown column type: {name}")
    return SPARK_TYPES[base]


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_moment(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def family(kind: T.DataType) -> str:
    """STRING, INTEGER, DECIMAL, BOOLEAN, DATE or OTHER."""
    if is_text(kind):
        return "STRING"
    if is_integral(kind):
        return "INTEGER"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "DECIMAL"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, T.DateType) or is_moment(kind):
        return "DATE"
    return "OTHER"


def sink_type(kind: T.DataType) -> str:
    """Type a destination column gets: integers widen to bigint, decimals and floats to double, dates to timestamp,
    everything else to text."""
    wide = {"INTEGER": "bigint", "DECIMAL": "double", "BOOLEAN": "boolean", "DATE": "timestamp_ntz"}
    return wide.get(family(kind), "string")


def to_sink_types(df: DataFrame) -> DataFrame:
    """Cast every column to the type its destination column has."""
    return df.select([F.col(f"`{f.name}`").cast(sink_type(f.dataType)).alias(f.name) for f in df.schema.fields])


def as_text(column: Column) -> Column:
    return column.cast("string")
