import pytest
from pyspark.sql import functions as F

from tablemill.functions.scalars import CATALOGUE, FunctionError, call, call_null_safe, case, concat_operator, divide, from_spec, java_pattern


@pytest.fixture
def one(spark):
    return spark.sql("select 'hello' as s, cast(null as string) as n, 7 as i, 2 as j, 2.5d as d, timestamp_ntz'2024-03-10 14:05:06' as t, 12.5d as price")


def value(df, column):
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("start", "length", "expected"), [(1, 2, "he"), (0, 2, "h"), (-1, 3, "h"), (-5, 3, ""), (2, None, "ello"), (9, 2, ""), (4, 9, "lo")])
def test_substring(one, start, length, expected):
    arguments = [F.col("s"), start] + ([length] if length is not None else [])
    assert value(one, call("SUBSTRING", *arguments)) == expected


def test_concat_skips_nulls_and_the_operator_does_not(one):
    assert value(one, call("CONCAT", F.col("s"), F.col("n"), F.col("i"))) == "hello7"
    assert value(one, concat_operator(F.col("s"), F.col("n"))) is None


def test_numbers(one):
    assert value(one, divide(one, F.col("i"), F.col("j"))) == 3
    assert value(one, divide(one, -F.col("i"), F.col("j"))) == -3
    assert value(one, divide(one, F.col("i"), F.col("d"))) == 2.8
    assert value(one, call("LOG", F.lit(1000.0))) == pytest.approx(3)
    assert value(one, call("MOD", F.lit(-7), 3)) == -1
    assert value(one, call("ROUND", F.col("d"))) == 3.0
    assert value(one, call("TO_NUMBER", F.lit("12.50"))) == 12.5


def test_dates(one):
    assert value(one, call("EXTRACT", "DOW", F.col("t"))) == 0  # a Sunday
    assert value(one, call("TO_CHAR", F.col("t"), "DD.MM.YY at HH24h")) == "10.03.24 at 14h"
    assert str(value(one, call("TO_DATE", F.lit("10/03/2024"), "DD/MM/YYYY"))) == "2024-03-10"
    assert str(value(one, call("DATE_TRUNC", "month", F.col("t")))) == "2024-03-01 00:00:00"
    assert str(value(one, call("DATEADD", "days", -10, F.col("t")))) == "2024-02-29 14:05:06"
    assert value(one, call("DATEDIFF", "hour", F.col("t"), F.col("t") + F.expr("interval 90 minutes"))) == 1
    assert (value(one, call("YEAR", F.col("t"))), value(one, call("MONTH", F.col("t"))), value(one, call("DAY", F.col("t")))) == (2024, 3, 10)
    with pytest.raises(FunctionError):
        call("DATEADD", "fortnight", 1, F.col("t"))


def test_patterns():
    assert java_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    assert java_pattern("DD.MM.YYYYTHH12") == "dd.MM.yyyy'T'hh"


def test_case_keeps_literals(one):
    assert value(one, case([(F.col("i") > 5, "Mixed Case when")], "other")) == "Mixed Case when"
    assert value(one, case([(F.col("i") > 9, "x")])) is None


def test_null_safe(one):
    assert value(one, call_null_safe("UPPER", F.col("n"))) == ""
    assert value(one, call_null_safe("SUBSTRING", F.col("n"), 1, 2)) == ""
    assert value(one, call_null_safe("LENGTH", F.col("n"))) is None


def test_cast_raises_on_bad_text(one):
    assert value(one, call("CAST", F.col("i"), "STRING")) == "7"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(one, call("CAST", F.col("s"), "INTEGER"))


def test_argument_counts():
    for name, arguments in (("UPPER", ()), ("CONCAT", ("a",)), ("REPLACE", ("a", "b")), ("NOPE", ())):
        with pytest.raises(FunctionError):
            call(name, *arguments)


def test_specs(one):
    assert value(one, from_spec({"function": "REPLACE", "arguments": [{"column": "s"}, "l", "L"]})) == "heLLo"
    assert value(one, from_spec({"function": "UPPER", "arguments": [{"column": "n"}]}, null_safe=True)) == ""


def test_every_function_states_its_arguments():
    assert all(most is None or fewest <= most for _, fewest, most in CATALOGUE.values())
