"""Cleaning and type inference."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.ingest import cleaning, inference
from tablemill.ingest.upload import upload
from tablemill.ingest.moments import DATE_FORMATS


@query("cln_empty_rows", r"""SELECT * FROM (SELECT event_id AS row_number, CASE WHEN value < 5 THEN NULL ELSE event_type END AS kind,
    CASE WHEN value < 10 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS who FROM events) WHERE kind IS NOT NULL OR who IS NOT NULL""")
def empty_rows(t: Tables) -> DataFrame:
    value = F.col("value")
    rows = t.events.select(F.col("event_id").alias("row_number"), F.when(value < 5, F.lit(" \t")).otherwise(F.col("event_type")).alias("kind"),
                           F.when(value < 10, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("who"))
    return cleaning.drop_empty_rows(rows, ["row_number"])


@query("cln_scientific", """SELECT p_partkey, CAST(p_size * 1000 AS VARCHAR) AS whole, CAST(p_size AS VARCHAR) || '.25' AS part, p_type AS word FROM part""")
def scientific(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = t.part.select("p_partkey", F.concat(size, F.lit(".0E+3")).alias("whole"), F.concat(size, F.lit("25e-2")).alias("part"), F.col("p_type").alias("word"))
    return rows.withColumns({"whole": cleaning.plain_number(F.col("whole")), "part": cleaning.plain_number(F.col("part"), "numeric"),
                             "word": cleaning.plain_number(F.col("word"))})


@query("cln_column_names", 'SELECT c_custkey AS customer_key, c_name AS full_name, c_acctbal AS account_balance FROM customer')
def column_names(t: Tables) -> DataFrame:
    named = t.customer.select(F.col("c_custkey").alias(" Customer-Key"), F.col("c_name").alias("Full Name"), F.col("c_acctbal").alias("ACCOUNT BALANCE "))
    return cleaning.clean_column_names(named)


@query("cln_rules", """SELECT min(event_id) AS event_id, date_trunc('day', ts) AS the_day, event_type FROM events GROUP BY ALL""")
def clean(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.date_format("ts", "MM/dd/yyyy").alias("The Day"), F.col("event_type").alias("Event-Type"))
    return cleaning.clean(rows, {"empty_rows": True, "keep": ["event_id"], "dates": {"The Day": "%m/%d/%Y"}, "distinct": True, "row_number": "event_id", "names": True})


TEXT_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey * 1000000 AS VARCHAR) AS big, strftime(o_orderdate, '%d/%m/%Y') AS day,
    strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS moment, CAST(o_totalprice AS VARCHAR) AS price, o_orderpriority AS priority,
    CAST(o_custkey AS VARCHAR) AS contact_no, '+' || CAST(o_custkey AS VARCHAR) AS intl, CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS rough,
    CAST(o_custkey AS VARCHAR) || '.0' AS whole FROM orders"""


def text_orders(t: Tables) -> DataFrame:
    """Orders as an uploaded text table."""
    key, who, moment = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderdate")
    return t.orders.select(
        key.cast("string").alias("key"), (key * 1000000).cast("string").alias("big"), F.date_format(moment, "dd/MM/yyyy").alias("day"),
        F.date_format(moment + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("priority"), who.alias("contact_no"), F.concat(F.lit("+"), who).alias("intl"),
        F.when(F.col("o_orderstatus") == "P", F.lit("x")).otherwise(F.date_format(moment, "yyyy-MM-dd")).alias("rough"), F.concat(who, F.lit(".0")).alias("whole"))


HITS = ", ".join(f"count(*) FILTER (try_strptime(value, '{f}') IS NOT NULL AND length(value) >= 8)" for f in DATE_FORMATS)
NAMES = ", ".join(f"'{f}'" for f in DATE_FORMATS)
CELLS = f"""WITH w AS ({TEXT_SQL}), c AS (UNPIVOT w ON COLUMNS(*) INTO NAME column_name VALUE value),
    h AS (SELECT column_name, count(*) AS n, [{HITS}] AS hits FROM c GROUP BY column_name),
    d AS (SELECT column_name, CASE WHEN list_max(hits) > 0.6 * n THEN [{NAMES}][list_position(hits, list_max(hits))] END AS date_format FROM h)"""


@query("inf_date_format", CELLS + " SELECT column_name, date_format FROM d")
def date_format(t: Tables) -> DataFrame:
    return inference.date_formats(text_orders(t))


@query("inf_date_or_ts", """SELECT 'o_orderdate' AS column_name, CASE WHEN bool_or(o_orderdate <> date_trunc('day', o_orderdate)) THEN 'TIMESTAMP' ELSE 'DATE' END AS kind FROM orders
    UNION ALL SELECT 'later', 'TIMESTAMP'""")
def date_or_timestamp(t: Tables) -> DataFrame:
    return inference.moment_kinds(t.orders.select("o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE")).alias("later")))


@query("inf_type", CELLS + """, m AS (SELECT column_name, max(length(value)) AS longest, bool_or(contains(value, '+')) AS plus, bool_and(regexp_matches(value, '^[0-9]+$')) AS digits,
    bool_and(regexp_matches(value, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$')) AS decimals, bool_and(coalesce(try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE)), true)) AS whole,
    max(try_cast(value AS DOUBLE)) AS largest FROM c GROUP BY column_name)
    SELECT column_name, date_format, CAST(longest AS BIGINT) AS max_length, CASE WHEN date_format LIKE '%:%' THEN 'TIMESTAMP' WHEN date_format IS NOT NULL THEN 'DATE'
    WHEN regexp_matches(column_name, 'phone|mobile|tel|contact') THEN 'VARCHAR(20)' WHEN plus THEN 'VARCHAR(' || (longest + 50) || ')'
    WHEN digits OR (decimals AND whole) THEN CASE WHEN largest <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END WHEN decimals THEN 'REAL'
    ELSE 'VARCHAR(' || (longest + 50) || ')' END AS inferred_type FROM m JOIN d USING (column_name)""")
def column_type(t: Tables) -> DataFrame:
    return inference.infer_types(text_orders(t))


@query("inf_sink_type", f"""WITH w AS ({TEXT_SQL}) SELECT * FROM (VALUES ('key', 'BIGINT'), ('big', 'BIGINT'), ('day', 'TEXT'), ('moment', 'TIMESTAMP'), ('price', 'DOUBLE PRECISION'),
    ('priority', 'TEXT'), ('contact_no', 'BIGINT'), ('intl', 'BIGINT'), ('rough', 'TEXT'), ('whole', 'DOUBLE PRECISION')) v(column_name, sink_type) WHERE (SELECT count(*) FROM w) > 0""")
def sink_type(t: Tables) -> DataFrame:
    return inference.sink_types(text_orders(t))


@query("cnv_dates", "SELECT o_orderkey, o_orderdate AS day, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS rough FROM orders")
def convert_dates(t: Tables) -> DataFrame:
    rows = text_orders(t).select(F.col("key").cast("bigint").alias("o_orderkey"), "day", "rough")
    formats = {r.column_name: r.date_format for r in inference.date_formats(rows.select("day", "rough")).collect()}
    return cleaning.convert_dates(rows, formats)


@query("src_upload", """SELECT row_number() OVER (ORDER BY o_orderkey) AS __id, CAST(o_orderkey AS INTEGER) AS "key", o_orderkey * 1000000 AS big, CAST(o_orderdate AS DATE) AS day,
    o_orderdate + INTERVAL 90 MINUTE AS moment, o_totalprice AS price, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS contact_no,
    '+' || CAST(o_custkey AS VARCHAR) AS intl, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS rough, CAST(o_custkey AS INTEGER) AS whole,
    true AS __active FROM orders""")
def uploaded(t: Tables) -> DataFrame:
    return upload(text_orders(t), {"big": ("BIGINT", None), "rough": ("DATE", "%Y-%m-%d")}, ["key"])
