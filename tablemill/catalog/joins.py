"""Joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.operators.joins import join

CUSTOMER_ORDERS = [{"leftColumn": "c_custkey", "rightColumn": "o_custkey"}]
COLUMNS = ["c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"]
SELECT = "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer {how} JOIN orders ON c_custkey = o_custkey"
DOCS_LABELS = [{"leftColumn": "doc_id", "rightColumn": "doc_id"}]


@query("jn_inner", SELECT.format(how="INNER"))
def inner(t: Tables) -> DataFrame:
    return join(t.customer, t.orders, CUSTOMER_ORDERS, "INNER").select(COLUMNS)


@query("jn_unknown_type", SELECT.format(how="INNER"))
def unknown_type(t: Tables) -> DataFrame:
    return join(t.customer, t.orders, CUSTOMER_ORDERS, "SIDEWAYS").select(COLUMNS)


@query("jn_left", SELECT.format(how="LEFT"))
def left(t: Tables) -> DataFrame:
    return join(t.customer, t.orders, CUSTOMER_ORDERS, "LEFT").select(COLUMNS)


@query("jn_right", """SELECT l.doc_id AS _L_doc_id, d.doc_id AS _R_doc_id, lang, quality
    FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id""")
def right(t: Tables) -> DataFrame:
    return join(t.labels, t.documents, DOCS_LABELS, "RIGHT").select("_L_doc_id", "_R_doc_id", "lang", "quality")


@query("jn_full", "SELECT s_suppkey, c_custkey, s_nationkey, c_nationkey FROM supplier FULL JOIN customer ON s_suppkey = c_nationkey")
def full(t: Tables) -> DataFrame:
    return join(t.supplier, t.customer, [{"leftColumn": "s_suppkey", "rightColumn": "c_nationkey"}], "FULL").select("s_suppkey", "c_custkey", "s_nationkey", "c_nationkey")


@query("jn_cross", "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def cross(t: Tables) -> DataFrame:
    return join(t.supplier, t.region).select("s_suppkey", "r_name")


@query("jn_multi_key", """SELECT a.l_orderkey AS _L_l_orderkey, a.l_linenumber AS _L_l_linenumber, a.l_quantity AS _L_l_quantity, b.l_tax AS _R_l_tax
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey""")
def multi_key(t: Tables) -> DataFrame:
    keys = [{"leftColumn": k, "rightColumn": k} for k in ("l_orderkey", "l_linenumber", "l_partkey")]
    return join(t.lineitem, t.lineitem, keys).select("_L_l_orderkey", "_L_l_linenumber", "_L_l_quantity", "_R_l_tax")


@query("jn_theta", """SELECT o_orderkey, l_linenumber, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate > l_shipdate""")
def theta(t: Tables) -> DataFrame:
    conditions = [{"leftColumn": "o_orderkey", "rightColumn": "l_orderkey"}, {"leftColumn": "o_orderdate", "rightColumn": "l_shipdate", "operator": ">"}]
    return join(t.orders, t.lineitem, conditions).select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@query("jn_self", """SELECT a.o_orderkey AS _L_o_orderkey, b.o_orderkey AS _R_o_orderkey, b.o_totalprice AS _R_o_totalprice
    FROM orders a JOIN orders b ON a.o_custkey = b.o_orderkey""")
def self_join(t: Tables) -> DataFrame:
    orders = t.orders
    pairs = join(orders, orders, [{"leftColumn": "o_custkey", "rightColumn": "o_orderkey"}])
    return pairs.select("_L_o_orderkey", "_R_o_orderkey", "_R_o_totalprice")


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
BOTH_SIDES = ", ".join(f"{alias}.{c} AS {prefix}{c}" for alias, prefix in (("a", "_L_"), ("b", "_R_")) for c in ORDER_COLUMNS)


@query("jn_conflict_prefix", f"SELECT {BOTH_SIDES} FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_orderkey")
def conflict_prefix(t: Tables) -> DataFrame:
    return join(t.orders, t.orders, [{"leftColumn": "o_custkey", "rightColumn": "o_orderkey"}], "LEFT")


@query("jn_output_columns", """SELECT o_orderkey AS order_id, c_name AS customer, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def output_columns(t: Tables) -> DataFrame:
    outputs = [{"column": "o_orderkey", "source": "left", "outputName": "order_id"}, {"column": "c_name", "source": "right", "outputName": "customer"},
               {"column": "c_mktsegment", "source": "right", "included": False}, {"column": "o_totalprice", "source": "left"}]
    return join(t.orders, t.customer, [{"leftColumn": "o_custkey", "rightColumn": "c_custkey"}], output_columns=outputs)


@query("jn_filtered", SELECT.format(how="LEFT") + " WHERE o_totalprice > 100000 OR o_orderkey IS NULL")
def filtered(t: Tables) -> DataFrame:
    where = {"conditions": [{"column": "o_totalprice", "operator": ">", "value": 100000},
                            {"column": "o_orderkey", "operator": "IS NULL", "logicalOperator": "OR"}]}
    return join(t.customer, t.orders, CUSTOMER_ORDERS, "LEFT", where=where).select(COLUMNS)


@query("jn_strategy", SELECT.format(how="LEFT"))
def split_hot_keys(t: Tables) -> DataFrame:
    return join(t.customer, t.orders, CUSTOMER_ORDERS, "LEFT", split_hot=True).select(COLUMNS)


BANDS = "SELECT c_custkey, c_acctbal - 25 AS low, c_acctbal + (c_custkey % 7) * 40 AS high FROM customer"
BAND_CONDITIONS = [{"leftColumn": "p_retailprice", "rightColumn": "low", "operator": ">="}, {"leftColumn": "p_retailprice", "rightColumn": "high", "operator": "<"}]


def bands(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (F.col("c_acctbal") - 25).alias("low"), (F.col("c_acctbal") + F.col("c_custkey") % 7 * 40).alias("high"))


@query("jn_band", f"SELECT p_partkey, p_retailprice, c_custkey FROM part JOIN ({BANDS}) ON p_retailprice >= low AND p_retailprice < high")
def band(t: Tables) -> DataFrame:
    return join(t.part, bands(t), BAND_CONDITIONS).select("p_partkey", "p_retailprice", "c_custkey")


@query("jn_band_full", f"SELECT p_partkey, p_retailprice, c_custkey FROM part FULL JOIN ({BANDS}) ON p_retailprice >= low AND p_retailprice < high")
def band_full(t: Tables) -> DataFrame:
    return join(t.part, bands(t), BAND_CONDITIONS, "FULL").select("p_partkey", "p_retailprice", "c_custkey")


@query("jn_band_moments", """SELECT o_orderkey, o_orderdate, event_id, since FROM orders JOIN (SELECT event_id, ts - INTERVAL 25 YEARS AS since, ts - INTERVAL 25 YEARS + to_days(CAST(event_id % 3 AS INTEGER)) AS until FROM events)
    ON o_orderdate BETWEEN since AND until""")
def band_moments(t: Tables) -> DataFrame:
    since = F.expr("ts - INTERVAL '25' YEAR")
    spans = t.events.select("event_id", since.alias("since"), (since + F.make_dt_interval((F.col("event_id") % 3).cast("int"))).alias("until"))
    conditions = [{"leftColumn": "since", "rightColumn": "o_orderdate", "operator": "<="}, {"leftColumn": "until", "rightColumn": "o_orderdate", "operator": ">="}]
    return join(spans, t.orders, conditions).select("o_orderkey", "o_orderdate", "event_id", "since")
