"""Scalar functions, each over a whole table."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.functions.scalars import call, case, concat_operator, divide

KEYS = {"part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "supplier": "s_suppkey"}


def scalar(name: str, table: str, build: Callable[[], Column], sql: str) -> None:
    """A query of one function result per row of a table."""
    key = KEYS[table]
    query(name, f"SELECT {key}, {sql} AS v FROM {table}")(lambda t: getattr(t, table).select(key, build().alias("v")))


def c(name: str) -> Column:
    return F.col(name)


def digits(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


scalar("fn_upper", "part", lambda: call("UPPER", c("p_name")), "upper(p_name)")
scalar("fn_lower", "part", lambda: call("LOWER", c("p_brand")), "lower(p_brand)")
scalar("fn_substring", "part", lambda: call("SUBSTRING", c("p_name"), 3, 4), "substring(p_name, 3, 4)")
scalar("fn_substring_zero", "part", lambda: call("SUBSTR", c("p_name"), 0, 4), "substring(p_name, 1, 3)")
scalar("fn_substring_tail", "part", lambda: call("SUBSTRING", c("p_name"), 5), "substring(p_name, 5)")
scalar("fn_concat", "part", lambda: call("CONCAT", c("p_brand"), F.nullif(c("p_type"), F.lit("SMALL")), c("p_size")),
       "concat(p_brand, nullif(p_type, 'SMALL'), p_size)")
scalar("fn_concat_op", "part", lambda: concat_operator(c("p_brand"), "-", F.nullif(c("p_type"), F.lit("SMALL"))),
       "p_brand || '-' || nullif(p_type, 'SMALL')")
scalar("fn_length", "part", lambda: call("LENGTH", c("p_name")).cast("bigint"), "length(p_name)")
scalar("fn_trim", "part", lambda: call("TRIM", F.concat(F.lit("  "), c("p_name"), F.lit(" "))), "trim('  ' || p_name || ' ')")
scalar("fn_ltrim", "part", lambda: call("LTRIM", F.concat(F.lit("  "), c("p_name"), F.lit(" "))), "ltrim('  ' || p_name || ' ')")
scalar("fn_rtrim", "part", lambda: call("RTRIM", F.concat(F.lit("  "), c("p_name"), F.lit(" "))), "rtrim('  ' || p_name || ' ')")
scalar("fn_replace", "part", lambda: call("REPLACE", c("p_brand"), "Brand#", "B-"), "replace(p_brand, 'Brand#', 'B-')")
scalar("fn_abs", "customer", lambda: call("ABS", c("c_acctbal") - 5000), "abs(c_acctbal - 5000)")
scalar("fn_floor", "customer", lambda: call("FLOOR", c("c_acctbal")), "CAST(floor(c_acctbal) AS BIGINT)")
scalar("fn_ceil", "customer", lambda: call("CEIL", c("c_acctbal")), "CAST(ceil(c_acctbal) AS BIGINT)")
scalar("fn_sqrt", "customer", lambda: digits(call("SQRT", call("ABS", c("c_acctbal")))), "round(sqrt(abs(c_acctbal)), 6)")
scalar("fn_power", "part", lambda: digits(call("POWER", c("p_size"), 2)), "round(power(p_size, 2), 6)")
scalar("fn_exp", "part", lambda: digits(call("EXP", c("p_size") / 10)), "round(exp(p_size / 10), 6)")
scalar("fn_round", "customer", lambda: call("ROUND", c("c_acctbal")), "round(c_acctbal)")
scalar("fn_round_digits", "orders", lambda: call("ROUND", c("o_totalprice") / 7, 3), "round(o_totalprice / 7, 3)")
scalar("fn_ln", "part", lambda: digits(call("LN", c("p_retailprice"))), "round(ln(p_retailprice), 6)")
scalar("fn_log", "part", lambda: digits(call("LOG", c("p_retailprice"))), "round(log10(p_retailprice), 6)")
scalar("fn_mod", "orders", lambda: call("MOD", c("o_custkey") - 700, 7), "(o_custkey - 700) % 7")
scalar("fn_if", "orders", lambda: call("IF", c("o_totalprice") > 200000, "large", "small"), "if(o_totalprice > 200000, 'large', 'small')")
scalar("fn_extract", "events", lambda: call("EXTRACT", "dow", c("ts")), "CAST(extract('dow' FROM ts) AS DOUBLE)")
scalar("fn_date_part", "events", lambda: call("DATE_PART", "hour", c("ts")), "CAST(date_part('hour', ts) AS DOUBLE)")
scalar("fn_date_trunc", "events", lambda: call("DATE_TRUNC", "hour", c("ts")), "date_trunc('hour', ts)")
scalar("fn_to_date", "orders", lambda: call("TO_DATE", F.date_format("o_orderdate", "dd.MM.yyyy"), "DD.MM.YYYY"), "CAST(o_orderdate AS DATE)")
scalar("fn_to_char", "events", lambda: call("TO_CHAR", c("ts"), "YYYY/MM/DD HH24:MI:SS"), "strftime(ts, '%Y/%m/%d %H:%M:%S')")
scalar("fn_to_char_number", "part", lambda: F.trim(call("TO_CHAR", c("p_size"), "000000")), "lpad(CAST(p_size AS VARCHAR), 6, '0')")
scalar("fn_to_number", "part", lambda: call("TO_NUMBER", F.substring("p_brand", 7, 5)).cast("bigint"), "CAST(substring(p_brand, 7, 5) AS BIGINT)")
scalar("fn_dateadd", "orders", lambda: call("DATEADD", "month", 2, c("o_orderdate")), "o_orderdate + INTERVAL 2 MONTH")
scalar("fn_datediff", "orders", lambda: call("DATEDIFF", "day", F.lit("1990-01-01").cast("timestamp_ntz"), c("o_orderdate")),
       "date_sub('day', TIMESTAMP '1990-01-01', o_orderdate)")
scalar("fn_year", "orders", lambda: call("YEAR", c("o_orderdate")).cast("bigint"), "year(o_orderdate)")
scalar("fn_month", "orders", lambda: call("MONTH", c("o_orderdate")).cast("bigint"), "month(o_orderdate)")
scalar("fn_day", "orders", lambda: call("DAY", c("o_orderdate")).cast("bigint"), "day(o_orderdate)")
scalar("fn_cast", "orders", lambda: call("CAST", c("o_orderkey"), "STRING"), "CAST(o_orderkey AS VARCHAR)")
scalar("fn_case", "orders", lambda: case([(c("o_orderstatus") == "F", "Finished"), (c("o_orderstatus") == "O", "open, not Done")], "other"),
       "CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'open, not Done' ELSE 'other' END")
scalar("fn_coalesce", "orders", lambda: call("COALESCE", F.nullif(c("o_orderstatus"), F.lit("F")), "done"), "coalesce(nullif(o_orderstatus, 'F'), 'done')")
scalar("fn_nullif", "orders", lambda: call("NULLIF", c("o_orderpriority"), "5-LOW"), "nullif(o_orderpriority, '5-LOW')")


@query("fn_arith", "SELECT o_orderkey, (o_orderkey - 7000) // 7 AS whole, round(o_totalprice / 7, 4) AS part, o_custkey * 2 + 1 AS odd FROM orders")
def arithmetic(t: Tables) -> DataFrame:
    orders = t.orders
    whole = divide(orders, c("o_orderkey") - 7000, F.lit(7))
    part = divide(orders, c("o_totalprice"), F.lit(7))
    return orders.select("o_orderkey", whole.alias("whole"), F.round(part, 4).alias("part"), (c("o_custkey") * 2 + 1).alias("odd"))


COMPARED = "(p_size >= 10 AND NOT p_name LIKE 'red%') OR p_type IN ('SMALL', 'ECONOMY') AND p_brand ILIKE 'BRAND#1%' OR p_name IS NULL OR p_size <> 3 AND p_size != 4 AND p_size < 6"


@query("fn_compare", f"SELECT p_partkey, ({COMPARED}) AS v FROM part")
def comparisons(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr(COMPARED).alias("v"))


@query("fn_now", "SELECT o_orderkey, o_orderdate < CAST(now() AS TIMESTAMP) AS past, o_orderdate + INTERVAL 9000 DAY < CAST(now() AS TIMESTAMP) AS long_past FROM orders")
def now(t: Tables) -> DataFrame:
    moment = call("NOW").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", (c("o_orderdate") < moment).alias("past"), (c("o_orderdate") + F.expr("INTERVAL 9000 DAY") < moment).alias("long_past"))


@query("fn_current_date", "SELECT o_orderkey, o_orderdate < current_date AS past FROM orders")
def current_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (c("o_orderdate") < call("CURRENT_DATE")).alias("past"))


@query("fn_current_timestamp", "SELECT event_id, ts < CAST(now() AS TIMESTAMP) AS past FROM events")
def current_timestamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", (c("ts") < call("CURRENT_TIMESTAMP").cast("timestamp_ntz")).alias("past"))
