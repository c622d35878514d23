"""Profiles and validation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.quality import profile, rules


@query("prf_numeric", """SELECT 'l_quantity' AS column_name, min(l_quantity) AS min_value, max(l_quantity) AS max_value, CAST(NULL AS VARCHAR) AS exact_min, CAST(NULL AS VARCHAR) AS exact_max, count(*) AS total_count,
    count(*) FILTER (l_quantity = 0) AS zero_count, count(*) FILTER (l_quantity IS NULL) AS null_count FROM lineitem
    UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount), NULL, NULL, count(*), count(*) FILTER (l_discount = 0), count(*) FILTER (l_discount IS NULL) FROM lineitem
    UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber), CAST(min(l_linenumber) AS VARCHAR), CAST(max(l_linenumber) AS VARCHAR), count(*), count(*) FILTER (l_linenumber = 0), count(*) FILTER (l_linenumber IS NULL) FROM lineitem""")
def numeric(t: Tables) -> DataFrame:
    return profile.numeric_profile(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"])


@query("prf_numeric_wide", """SELECT 'wide' AS column_name, CAST(min(o_orderkey + 9007199254740993) AS DOUBLE) AS min_value, CAST(max(o_orderkey + 9007199254740993) AS DOUBLE) AS max_value,
    CAST(min(o_orderkey + 9007199254740993) AS VARCHAR) AS exact_min, CAST(max(o_orderkey + 9007199254740993) AS VARCHAR) AS exact_max, count(*) AS total_count, 0 AS zero_count, 0 AS null_count FROM orders
    UNION ALL SELECT 'price', CAST(min(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE), CAST(max(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE), CAST(min(CAST(o_totalprice AS DECIMAL(15,2))) AS VARCHAR),
    CAST(max(CAST(o_totalprice AS DECIMAL(15,2))) AS VARCHAR), count(*), 0, 0 FROM orders""")
def numeric_wide(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_orderkey") + 9007199254740993).alias("wide"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    return profile.numeric_profile(rows, ["wide", "price"])


@query("prf_string", """WITH v AS (SELECT CAST(quality AS VARCHAR) AS value FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'total' AS finding, NULL AS value, count(*) AS n FROM v UNION ALL SELECT 'null', NULL, count(*) FROM v WHERE value IS NULL
    UNION ALL SELECT 'value', value, count(*) FROM v WHERE value IS NOT NULL GROUP BY value""")
def string(t: Tables) -> DataFrame:
    return profile.string_profile(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")


DATE_TEXT = """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'soon' WHEN o_orderstatus = 'P' THEN NULL
    WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v, o_orderdate FROM orders"""


def date_text(t: Tables) -> DataFrame:
    priority, moment = F.col("o_orderpriority"), F.col("o_orderdate")
    return t.orders.select(F.when(priority == "1-URGENT", F.lit("soon")).when(F.col("o_orderstatus") == "P", F.lit(None))
                           .when(priority == "5-LOW", F.date_format(moment, "dd.MM.yyyy")).otherwise(F.date_format(moment, "yyyy-MM-dd")).alias("v"))


@query("prf_date", f"""SELECT count(*) AS total_count, count(*) FILTER (v IS NULL) AS null_count, count(v) AS non_null_count,
    min(CASE WHEN v <> 'soon' THEN o_orderdate END) AS min_date, max(CASE WHEN v <> 'soon' THEN o_orderdate END) AS max_date,
    count(*) FILTER (v = 'soon') AS invalid_date_count FROM ({DATE_TEXT})""")
def dates(t: Tables) -> DataFrame:
    return profile.date_profile(date_text(t), "v")


@query("prf_date_invalid", f"SELECT DISTINCT v AS value FROM ({DATE_TEXT}) WHERE v = 'soon'")
def invalid_dates(t: Tables) -> DataFrame:
    return profile.invalid_dates(date_text(t), "v")


CUSTOMER_NATION = """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' || lower(n_name) WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 1000 THEN NULL ELSE n_name END AS v
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def customer_nation(t: Tables) -> DataFrame:
    name, segment = F.col("n_name"), F.col("c_mktsegment")
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.when(segment == "BUILDING", F.concat(F.lit(" "), F.lower(name)))
                         .when((segment == "MACHINERY") & (F.col("c_acctbal") < 1000), F.lit(None)).otherwise(name).alias("v"))


def known_nations(t: Tables) -> DataFrame:
    return t.nation.join(t.region.filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("code"))


KNOWN = "SELECT upper(trim(n_name)) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"


@query("prf_country", f"""WITH v AS ({CUSTOMER_NATION}) SELECT 'null' AS finding, NULL AS value, count(*) AS n FROM v WHERE v IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'value', upper(trim(v)), count(*) FROM v WHERE v IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'invalid', upper(trim(v)), count(*) FROM v WHERE v IS NOT NULL AND upper(trim(v)) NOT IN ({KNOWN}) GROUP BY 2""")
def country(t: Tables) -> DataFrame:
    return profile.country_profile(customer_nation(t), "v", known_nations(t))


@query("prf_currency", f"""WITH v AS ({CUSTOMER_NATION}) SELECT 'null' AS finding, NULL AS value, count(*) AS n FROM v WHERE v IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'value', trim(v), count(*) FROM v WHERE v IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'invalid', v, count(*) FROM v WHERE v IS NOT NULL AND upper(trim(v)) NOT IN ({KNOWN}) GROUP BY 2""")
def currency(t: Tables) -> DataFrame:
    return profile.currency_profile(customer_nation(t), "v", known_nations(t))


@query("prf_units", """WITH v AS (SELECT split_part(p_name, ' ', 2) AS v FROM part) SELECT 'value' AS finding, trim(v) AS value, count(*) AS n FROM v GROUP BY 2
    UNION ALL SELECT 'invalid', trim(v), count(*) FROM v WHERE lower(trim(v)) NOT IN ('ring', 'bolt') GROUP BY 2""")
def units(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("Ring",), ("bolt",)], "unit string")
    return profile.unit_profile(t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("v")), "v", known)


PLACES = """SELECT CASE WHEN c_acctbal < 500 THEN NULL ELSE lower(n_name) END AS g, CASE WHEN c_acctbal > 9500 THEN 'ATLANTIS' WHEN c_acctbal > 9000 THEN NULL ELSE r_name END AS v
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = length(c_mktsegment) % 5"""
PAIRS = "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20"


def places(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("r_regionkey") == F.length("c_mktsegment") % 5)
    return joined.select(F.when(balance < 500, F.lit(None)).otherwise(F.lower("n_name")).alias("g"),
                         F.when(balance > 9500, F.lit("ATLANTIS")).when(balance > 9000, F.lit(None)).otherwise(F.col("r_name")).alias("v"))


def place_pairs(t: Tables) -> DataFrame:
    """A reference list that does not know every nation."""
    return t.nation.filter("n_nationkey < 20").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region"))


@query("prf_region", f"""WITH v AS ({PLACES}), p AS ({PAIRS}) SELECT 'total' AS finding, NULL AS group_value, NULL AS value, count(*) AS n FROM v
    UNION ALL SELECT 'null', NULL, NULL, count(*) FROM v WHERE v IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'value', g, v, count(*) FROM v WHERE g IS NOT NULL AND v IS NOT NULL GROUP BY g, v
    UNION ALL SELECT 'invalid', NULL, v, count(*) FROM v WHERE v IS NOT NULL AND v NOT IN (SELECT r_name FROM p) GROUP BY v
    UNION ALL SELECT 'mismatch', g, v, count(*) FROM v WHERE v IS NOT NULL AND upper(g) IN (SELECT n_name FROM p) AND NOT EXISTS
    (SELECT 1 FROM p WHERE p.n_name = upper(g) AND p.r_name = v) GROUP BY g, v""")
def region(t: Tables) -> DataFrame:
    return profile.region_profile(places(t), "g", "v", place_pairs(t))


@query("prf_postal", f"""WITH v AS ({PLACES}), p AS ({PAIRS}) SELECT 'total' AS finding, NULL AS group_value, NULL AS value, count(*) AS n FROM v
    UNION ALL SELECT 'null', NULL, NULL, count(*) FROM v WHERE v IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'value', g, v, count(*) FROM v WHERE g IS NOT NULL AND v IS NOT NULL GROUP BY g, v
    UNION ALL SELECT 'mismatch', g, v, count(*) FROM v WHERE g IS NOT NULL AND v IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM p WHERE p.n_name = upper(g) AND p.r_name = v) GROUP BY g, v""")
def postal(t: Tables) -> DataFrame:
    return profile.postal_profile(places(t), "g", "v", place_pairs(t), "country", "region")


def broken_sql(table: str, key: str, column: str, rule: str, test: str) -> str:
    return f"SELECT {key}, '{column}' AS column_name, '{rule}' AS rule, CAST({column} AS VARCHAR) AS value FROM {table} WHERE {test}"


@query("val_required", broken_sql("(SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id))", "doc_id", "quality", "required", "quality IS NULL"))
def required(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rules.violations(rows, [{"column": "quality", "rule": "required"}], "doc_id")


@query("val_min_length", broken_sql("documents", "doc_id", "text", "min_length", "length(text) < 400"))
def min_length(t: Tables) -> DataFrame:
    return rules.violations(t.documents, [{"column": "text", "rule": "min_length", "min": 400}], "doc_id")


@query("val_max_length", broken_sql("pages", "page_id", "url", "max_length", "length(url) > 40"))
def max_length(t: Tables) -> DataFrame:
    return rules.violations(t.pages, [{"column": "url", "rule": "max_length", "max": 40}], "page_id")


@query("val_regex", broken_sql("pages", "page_id", "url", "regex", "NOT regexp_matches(url, '^https://[a-z.]+/en/')"))
def regex(t: Tables) -> DataFrame:
    return rules.violations(t.pages, [{"column": "url", "rule": "regex", "pattern": "^https://[a-z.]+/en/"}], "page_id")


@query("val_range", broken_sql("orders", "o_orderkey", "o_totalprice", "range", "NOT (o_totalprice BETWEEN 50000 AND 450000)"))
def value_range(t: Tables) -> DataFrame:
    return rules.violations(t.orders, [{"column": "o_totalprice", "rule": "range", "min": 50000, "max": 450000}], "o_orderkey")


@query("val_email", broken_sql("(SELECT c_custkey, replace(c_name, '#', CASE WHEN c_nationkey < 5 THEN ' ' ELSE '.' END) || '@' || lower(c_mktsegment) || CASE WHEN c_nationkey = 9 THEN '' ELSE '.com' END AS mail FROM customer)",
                               "c_custkey", "mail", "email", "NOT regexp_matches(mail, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')"))
def email(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey")
    mail = F.concat(F.replace("c_name", F.lit("#"), F.when(nation < 5, " ").otherwise(".")), F.lit("@"), F.lower("c_mktsegment"), F.when(nation == 9, "").otherwise(".com"))
    return rules.violations(t.customer.select("c_custkey", mail.alias("mail")), [{"column": "mail", "rule": "email"}], "c_custkey")


@query("val_summary", """SELECT 'o_totalprice' AS column_name, 'range' AS rule, count(*) AS checked, count(*) FILTER (NOT (o_totalprice BETWEEN 50000 AND 450000)) AS failed FROM orders
    UNION ALL SELECT 'o_orderpriority', 'regex', count(*), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-')) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'max_length', count(*), count(*) FILTER (length(o_orderstatus) > 1) FROM orders""")
def summary(t: Tables) -> DataFrame:
    return rules.summary(t.orders, [{"column": "o_totalprice", "rule": "range", "min": 50000, "max": 450000},
                                    {"column": "o_orderpriority", "rule": "regex", "pattern": "^[1-3]-"}, {"column": "o_orderstatus", "rule": "max_length", "max": 1}])


@query("val_regex_compose", "SELECT p_partkey, regexp_matches(p_brand, '^[A-Z][a-z]+#.+$') AS open_end, regexp_matches(p_brand, '^[A-Z][a-z]+#[0-9]$') AS one_digit FROM part")
def composed_pattern(t: Tables) -> DataFrame:
    parts, brand = ["[A-Z]", "[a-z]+#"], F.col("p_brand")
    return t.part.select("p_partkey", brand.rlike(rules.compose_pattern(parts)).alias("open_end"), brand.rlike(rules.compose_pattern(parts, "[0-9]$")).alias("one_digit"))


@query("val_type", r"""SELECT event_id, regexp_matches(props, '^[0-9]+$') AS is_integer, regexp_matches(CAST(value AS VARCHAR), '^-?[0-9.]+$') AS is_number,
    event_type IN ('true', 'false') AS is_boolean, true AS is_date, false AS not_date, true AS is_timestamp, true AS is_time, true AS is_uuid, false AS not_uuid,
    json_valid(props) AS is_json, json_valid(event_type) AS word_is_json FROM events""")
def types(t: Tables) -> DataFrame:
    ts, fits = F.col("ts"), rules.fits_type
    texts = t.events.select(
        "event_id", "props", "event_type", F.col("value").cast("string").alias("value"), F.date_format(ts, "MM/dd/yyyy").alias("slashes"), F.date_format(ts, "MM-dd-yyyy").alias("dashes"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), F.date_format(ts, "h:mm:ss a").alias("clock"), F.md5(F.col("props").cast("binary")).alias("digest"))
    checks = {"is_integer": ("props", "integer"), "is_number": ("value", "numeric"), "is_boolean": ("event_type", "boolean"), "is_date": ("slashes", "date"), "not_date": ("dashes", "date"),
              "is_timestamp": ("moment", "timestamp"), "is_time": ("clock", "time"), "is_uuid": ("digest", "uuid"), "not_uuid": ("props", "uuid"), "is_json": ("props", "json"),
              "word_is_json": ("event_type", "json")}
    return texts.select("event_id", *[fits(F.col(column), kind).alias(name) for name, (column, kind) in checks.items()])


@query("val_expression", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 2) AS v, upper(l_returnflag) AS w FROM lineitem")
def expressions(t: Tables) -> DataFrame:
    """Of several expressions per result, the one the analyser accepts with the expected type is computed."""
    lines = t.lineitem
    numbers = ["l_quantity *", "weight * 2", "round(l_quantity, 1, 2, 3)", "upper(l_returnflag)", "round(l_quantity * 2, 2)"]
    texts = ["l_quantity + 1", "upper(l_returnflag)"]
    [number] = [e for e in numbers if not rules.check_expression(lines, e, "NUMERIC")]
    [text] = [e for e in texts if not rules.check_expression(lines, e, "STRING")]
    return lines.select("l_orderkey", "l_linenumber", F.expr(number).alias("v"), F.expr(text).alias("w"))


@query("val_expression_problems", """SELECT 'double' AS name, NULL AS kind, count(*) AS n, round(sum(l_quantity * 2), 2) AS total FROM lineitem
    UNION ALL SELECT v.name, v.kind, NULL, NULL FROM (VALUES ('cut', 'PARSE_SYNTAX_ERROR'), ('other column', 'UNRESOLVED_COLUMN'), ('text', 'TYPE')) v(name, kind)""")
def expression_problems(t: Tables) -> DataFrame:
    """The valid expressions measured over all rows, and what is wrong with the others."""
    expressions = {"cut": ("l_quantity *", "NUMERIC"), "other column": ("weight * 2", "NUMERIC"), "text": ("upper(l_returnflag)", "NUMERIC"), "double": ("l_quantity * 2", "NUMERIC")}
    valid, report = rules.valid_expressions(t.lineitem, expressions)
    [name] = [c for c in valid.columns if c in expressions]
    measured = valid.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(f"`{name}`").cast("double")), 2).alias("total"))
    return measured.unionByName(report.select("name", "kind"), allowMissingColumns=True).select("name", "kind", "n", "total")
