"""Date and time formats of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.patterns import java_date_pattern

# Formats tried in order; an earlier one wins a tie.
DATE_FORMATS = (
    "%Y-%m-%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%m-%d-%Y",
    "%d-%m-%Y",
    "%Y/%m/%d",
    "%Y%m%d",
    "%d.%m.%Y",
    "%Y-%m-%d %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m-%d-%Y %H:%M:%S",
    "%d-%m-%Y %H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%m-%d-%Y %H:%M:%S.%f",
    "%d-%m-%Y %H:%M:%S.%f",
    "%m/%d/%Y %H:%M:%S.%f",
    "%d/%m/%Y %H:%M:%S.%f",
)
# Accepted when a value is checked against DATE and TIMESTAMP.
CHECKED_DATES = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d")
CHECKED_TIMESTAMPS = (
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
)
# Format token -> (accepted text, Java pattern).
TOKENS = {
    "%Y": (r"\d{4}", "yyyy"),
    "%m": (r"(0?[1-9]|1[0-2])", "M"),
    "%d": (r"(0?[1-9]|[12]\d|3[01])", "d"),
    "%H": (r"([01]?\d|2[0-3])", "H"),
    "%M": (r"[0-5]?\d", "m"),
    "%S": (r"[0-5]?\d", "s"),
    "%f": (r"\d{1,6}", "SSSSSS"),
}
COMPACT = {"%Y%m%d": (r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])", "yyyyMMdd")}


# What any of the formats above looks like; one test that keeps other text away from all of them.
DATE_LIKE = r"^(\d{4}[-/]\d|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{8}$)"
CLOCK = r"([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d(\.\d{1,6})?"
READABLE = rf"^(\d{{4}}([-/])\d{{1,2}}\2\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\3\d{{4}}|\d{{8}})( {CLOCK})?$"


def has_time(fmt: str) -> bool:
    return "%H" in fmt


def shape(fmt: str) -> str:
    """Regular expression for text in ``fmt`` with month, day and hour in range."""
    if fmt in COMPACT:
        return f"^{COMPACT[fmt][0]}$"
    return "^" + "".join(TOKENS[p][0] if p in TOKENS else re.escape(p) for p in re.findall(r"%.|[^%]", fmt)) + "$"


def java(fmt: str) -> str:
    if fmt in COMPACT:
        return COMPACT[fmt][1]
    return java_date_pattern(fmt, {token: pattern for token, (_, pattern) in TOKENS.items()})


def parse(text: Column, fmt: str) -> Column:
    """Timestamp for text in ``fmt``, else null. The shape is tested first, so that the parser only sees text that can
    fail for a day its month does not have."""
    return F.when(text.rlike(shape(fmt)), F.try_to_timestamp(text, F.lit(java(fmt)))).cast("timestamp_ntz")


def layout(fmt: str) -> str:
    """Separators and part order of a format, as ``with_reading`` reports them: Y when the year comes first, D otherwise."""
    return ("Y" if fmt.startswith("%Y") else "D") + re.sub(r"%.", "", fmt)


def day_first(fmt: str) -> bool:
    return fmt.startswith("%d")


def with_reading(df: DataFrame, text: str) -> DataFrame:
    """Add ``reading``, how a text column reads as a date: a struct of (layout, first, second, timed), null where it does
    not read as one.

    ``first`` says whether year-month-day, or else month-day-year, is a day of the calendar, ``second`` the same for
    day-month-year, and ``timed`` whether the time is other than midnight. Few distinct values come out, so a column's
    formats can be scored by counting them instead of parsing every value in every format. The steps are columns of
    their own because Spark evaluates a column once, but an expression wherever it is repeated. Text without a digit in front meets no pattern.
    """
    column = F.col(f"`{text}`")
    dated = df.withColumn("__date", F.when(F.substring(column, 1, 1).between("0", "9") & column.rlike(READABLE), column))
    day = dated.withColumns({
        "__day": F.translate(F.substring_index("__date", " ", 1), "/.", "--"),
        "__layout": F.translate("__date", "0123456789", ""),
        "__timed": F.contains("__date", F.lit(":")) & F.substring_index("__date", " ", -1).rlike("[1-9]"),
    })
    compact = ~F.contains("__day", F.lit("-"))
    split = day.withColumn("__parts", F.when(compact, F.array(F.substring("__day", 1, 4), F.substring("__day", 5, 2), F.substring("__day", 7, 2)))
                           .otherwise(F.split("__day", "-")))
    numbers = split.withColumns({f"__{i}": F.get("__parts", F.lit(i)).cast("int") for i in range(3)}).withColumn(
        "__year_first", F.length(F.get("__parts", F.lit(0))) == 4)
    a, b, c, year_first = F.col("__0"), F.col("__1"), F.col("__2"), F.col("__year_first")
    read = F.when(F.col("__date").isNotNull(), F.struct(
        F.concat(F.when(year_first, "Y").otherwise("D"), F.col("__layout")).alias("layout"),
        _on_calendar(F.when(year_first, a).otherwise(c), F.when(year_first, b).otherwise(a), F.when(year_first, c).otherwise(b)).alias("first"),
        (~year_first & _on_calendar(c, b, a)).alias("second"),
        F.col("__timed").alias("timed")))
    return numbers.select(*[F.col(f"`{n}`") for n in df.columns], read.alias("reading"))


def _on_calendar(year: Column, month: Column, day: Column) -> Column:
    in_range = (year >= 1) & month.between(1, 12) & (day >= 1)
    return F.when(in_range, (day <= 28) | (day <= F.day(F.last_day(F.make_date(year, month, F.lit(1)))))).otherwise(F.lit(False))


def parse_any(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Timestamp by the first format that fits."""
    return F.when(text.rlike(DATE_LIKE), F.coalesce(*[parse(text, fmt) for fmt in formats]))
