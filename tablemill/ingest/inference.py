"""Column types of raw text tables, found in one aggregation over all columns and all rows.

The table is unpivoted to (column_name, value) in the map tasks and aggregated by column name and by how a value reads as a
date, of which there are a few dozen ways; every measure aggregates partially, so the shuffles carry few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.ingest.moments import DATE_FORMATS, day_first, has_time, layout, with_reading

# Fixed values.
DATE_SHARE = 0.6
PHONE_WORDS = ("phone", "mobile", "tel", "contact")
PHONE_TYPE = "VARCHAR(20)"
SPARE_LENGTH = 50
INTEGER_MAX = 2147483647


def unpivot(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One (column_name, value) row per cell."""
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns or df.columns])
    return texts.unpivot([], [F.col(f"`{c}`") for c in texts.columns], "column_name", "value")


def first_rows(df: DataFrame, columns: Sequence[str], row_key: str, rows: int) -> DataFrame:
    """The first ``rows`` non-null values of each column in ``row_key`` order, as (column_name, value): one bounded top-n
    per column."""
    picks = [df.filter(F.col(f"`{c}`").isNotNull()).orderBy(row_key).limit(rows)
             .select(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    result = picks[0]
    for pick in picks[1:]:
        result = result.unionByName(pick)
    return result


def _scores(readings: str) -> Column:
    """Per format a struct of (hits, place, fmt, timed) from the counted readings of a column, an array of (reading, n). The largest struct
    has the most hits and is the earliest format on a tie. Formats are data here, so the plan is small; a sum per format took longer to analyse
    than to run."""
    formats = ", ".join(f"struct({-i} AS place, '{f}' AS fmt, '{layout(f)}' AS layout, {day_first(f)} AS day_first, {has_time(f)} AS clock)"
                        for i, f in enumerate(DATE_FORMATS))
    read = f"filter({readings}, r -> r.reading.layout = f.layout AND if(f.day_first, r.reading.second, r.reading.first))"
    return F.expr(f"""transform(array({formats}), f -> struct(aggregate({read}, 0L, (total, r) -> total + r.n) AS hits, f.place AS place, f.fmt AS fmt,
        f.clock AND exists({read}, r -> r.reading.timed) AS timed))""")


def _best_format() -> Column:
    """The scored format if it covers more than the required share."""
    return F.when(F.col("best.hits") / F.nullif(F.col("n"), F.lit(0)) > DATE_SHARE, F.col("best.fmt"))


def _readings() -> Column:
    """Counted readings of a column, of which there are a few dozen whatever the table."""
    return F.collect_list(F.when(F.col("reading").isNotNull(), F.struct("reading", "n")))


def date_formats(df: DataFrame, columns: Sequence[str] = (), row_key: str | None = None, first: int | None = None) -> DataFrame:
    """Detected format per column as (column_name, date_format); null where no format fits more than 60 % of the values.

    All rows are scored. ``first`` with ``row_key`` scores the first values only, as an interactive preview would.
    """
    names = [c for c in (columns or df.columns) if c != row_key]
    cells = first_rows(df, names, row_key, first) if first and row_key else unpivot(df, names)
    counted = with_reading(cells, "value").groupBy("column_name", "reading").agg(F.count("value").alias("n"))
    scored = counted.groupBy("column_name").agg(F.sum("n").alias("n"), _readings().alias("readings")).withColumn("best", F.array_max(_scores("readings")))
    return scored.select("column_name", _best_format().alias("date_format"))


def infer_types(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Type per column as (column_name, date_format, max_length, inferred_type).

    In order: a date format makes DATE or TIMESTAMP, a phone-like name VARCHAR(20), a plus sign VARCHAR, digits only
    INTEGER or BIGINT by range, decimals REAL (INTEGER or BIGINT when all are whole), anything else VARCHAR. VARCHAR
    leaves room for fifty characters more than the longest value.
    """
    value = F.col("value")
    led = F.substring(value, 1, 1).between(".", "9")
    cells = unpivot(df, columns).withColumn("decimal", F.when(value.isNotNull(), led & value.rlike(r"^(\d+\.?\d*|\.\d+)$"))).withColumn(
        "number", F.when(F.col("decimal"), value.try_cast("double")))
    counted = with_reading(cells, "value").groupBy("column_name", "reading").agg(
        F.count(value).alias("n"),
        F.max(F.length(value)).alias("longest"),
        F.bool_or(value.contains("+")).alias("plus"),
        F.bool_and(F.col("decimal") & ~value.contains(".")).alias("digits"),
        F.bool_and("decimal").alias("decimals"),
        F.bool_and(F.col("number") == F.rint("number")).alias("whole"),
        F.max("number").alias("largest"),
    )
    measured = counted.groupBy("column_name").agg(
        F.sum("n").alias("n"),
        F.max("longest").alias("longest"),
        F.coalesce(F.bool_or("plus"), F.lit(False)).alias("plus"),
        F.coalesce(F.bool_and("digits"), F.lit(True)).alias("digits"),
        F.coalesce(F.bool_and("decimals"), F.lit(True)).alias("decimals"),
        F.coalesce(F.bool_and("whole"), F.lit(True)).alias("whole"),
        F.coalesce(F.max("largest"), F.lit(0)).alias("largest"),
        _readings().alias("readings"),
    )
    found = measured.withColumn("best", F.array_max(_scores("readings"))).withColumn("date_format", _best_format())
    phone = F.lower("column_name").rlike("|".join(PHONE_WORDS))
    text = F.concat(F.lit("VARCHAR("), (F.coalesce(F.col("longest"), F.lit(0)) + SPARE_LENGTH).cast("string"), F.lit(")"))
    whole = F.when(F.col("largest") <= INTEGER_MAX, F.lit("INTEGER")).otherwise(F.lit("BIGINT"))
    kind = (F.when(F.col("date_format").isNotNull(), F.when(F.col("best.timed"), F.lit("TIMESTAMP")).otherwise(F.lit("DATE")))
            .when(phone, F.lit(PHONE_TYPE))
            .when(F.col("plus"), text)
            .when(F.col("digits"), whole)
            .when(F.col("decimals"), F.when(F.col("whole"), whole).otherwise(F.lit("REAL")))
            .otherwise(text))
    return found.select("column_name", "date_format", F.col("longest").cast("bigint").alias("max_length"), kind.alias("inferred_type"))


def moment_kinds(df: DataFrame) -> DataFrame:
    """DATE or TIMESTAMP per timestamp column as (column_name, kind): DATE when every value is at midnight, TIMESTAMP
    also when there is no value."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith("timestamp")]
    late = [F.coalesce(F.bool_or(F.col(f"`{c}`") != F.date_trunc("DAY", F.col(f"`{c}`")).cast("timestamp_ntz")), F.lit(True)).alias(c)
            for c in names]
    cells = [F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"`{c}`"), F.lit("TIMESTAMP")).otherwise(F.lit("DATE")).alias("kind"))
             for c in names]
    return df.agg(*late).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def sink_types(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Destination type per column from the values seen, as (column_name, sink_type): whole numbers BIGINT, numbers with
    some fraction DOUBLE PRECISION, true and false BOOLEAN, dates TIMESTAMP; text or a mixture TEXT."""
    value = F.trim(F.col("value"))
    kind = (F.when(value.isNull(), F.lit(None))
            .when(value.rlike(r"^[+-]?\d+$"), F.lit("whole"))
            .when(value.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(\.\d*)?[eE][+-]?\d+)$"), F.lit("fraction"))
            .when(F.lower(value).isin("true", "false"), F.lit("truth"))
            .when(value.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.lit("moment"))
            .otherwise(F.lit("text")))
    seen = unpivot(df, columns).select("column_name", kind.alias("kind")).groupBy("column_name").agg(
        *[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("whole", "fraction", "truth", "moment", "text")])
    only = {k: ~F.greatest(*[F.col(o) for o in ("whole", "fraction", "truth", "moment", "text") if o != k]) for k in ("whole", "truth", "moment")}
    numeric = ~F.greatest("truth", "moment", "text")
    chosen = (F.when(F.col("whole") & only["whole"], F.lit("BIGINT"))
              .when(F.col("fraction") & numeric, F.lit("DOUBLE PRECISION"))
              .when(F.col("truth") & only["truth"], F.lit("BOOLEAN"))
              .when(F.col("moment") & only["moment"], F.lit("TIMESTAMP"))
              .otherwise(F.lit("TEXT")))
    return seen.select("column_name", chosen.alias("sink_type"))
