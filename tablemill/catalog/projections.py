"""Projection and calculated columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.functions.scalars import call, call_null_safe
from tablemill.operators.joins import join
from tablemill.operators.projection import calculate, computed, include, project, rename_map


@query("prj_include", "SELECT c_mktsegment, c_custkey FROM customer")
def included(t: Tables) -> DataFrame:
    return project(t.customer, {"selectedColumns": ["c_mktsegment", "not_there", "c_custkey"]})


@query("prj_exclude", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def excluded(t: Tables) -> DataFrame:
    return project(t.customer, {"selectedMode": "EXCLUDE", "excludedColumns": ["c_acctbal", "c_mktsegment"]})


@query("prj_order", "SELECT p_brand, p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def ordered(t: Tables) -> DataFrame:
    return project(t.part, {"columnOrder": ["p_brand", "p_partkey"]})


@query("prj_dedupe", "SELECT o_orderkey, o_orderstatus FROM orders")
def repeated_names(t: Tables) -> DataFrame:
    return include(t.orders, ["o_orderkey", "o_orderstatus", "o_orderkey"])


@query("prj_join_name_map", """SELECT a.c_name AS _L_c_name, b.c_name AS _R_c_name, a.c_nationkey AS _L_c_nationkey
    FROM customer a JOIN customer b ON a.c_nationkey = b.c_custkey""")
def joined_names(t: Tables) -> DataFrame:
    pairs = join(t.customer, t.customer, [{"leftColumn": "c_nationkey", "rightColumn": "c_custkey"}])
    return include(pairs, ["c_name", "c_nationkey_l"])


@query("prj_map", "SELECT s_suppkey AS id, s_name AS supplier FROM supplier")
def mapped(t: Tables) -> DataFrame:
    return rename_map(t.supplier, {"s_suppkey": "id", "s_name": "supplier"})


@query("cal_column", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
    CAST(l_quantity AS BIGINT) AS quantity FROM lineitem""")
def calculated(t: Tables) -> DataFrame:
    spec = {"calculatedColumns": [{"name": "charge", "expression": "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)"},
                                  {"name": "quantity", "expression": "l_quantity", "dataType": "BIGINT"},
                                  {"name": "l_orderkey", "expression": "0"}],
            "selectedColumns": ["l_orderkey", "l_linenumber"]}
    return project(t.lineitem, spec)


@query("cal_dependent", """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS c, l_quantity * 2 + 1 AS d, (l_quantity * 2 + 1) * 10 AS e FROM lineitem""")
def dependent(t: Tables) -> DataFrame:
    columns = [{"name": "e", "expression": "d * 10"}, {"name": "d", "expression": "c + 1"}, {"name": "c", "expression": "l_quantity * 2"},
               {"name": "d", "expression": "0"}]
    return calculate(t.lineitem, columns).select("l_orderkey", "l_linenumber", "c", "d", "e")


@query("cal_computed", "SELECT *, s_acctbal > 5000 AS is_rich, upper(s_name) AS label FROM supplier")
def sql_columns(t: Tables) -> DataFrame:
    return computed(t.supplier, [{"alias": "is_rich", "expression": "s_acctbal > 5000"}, {"alias": "label", "expression": "upper(s_name)"}])


@query("cal_text_safe", """SELECT o_orderkey, length(CAST(o_custkey AS VARCHAR)) AS digits, substring(CAST(o_custkey AS VARCHAR), 1, 2) AS head FROM orders""")
def text_of_numbers(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", call("LENGTH", F.col("o_custkey")).cast("bigint").alias("digits"), call("SUBSTRING", F.col("o_custkey"), 1, 2).alias("head"))


@query("cal_null_safe", """SELECT doc_id, upper(coalesce(CAST(quality AS VARCHAR), '')) AS up, coalesce(lang, '') || coalesce(CAST(toxic AS VARCHAR), '') AS tag
    FROM documents LEFT JOIN labels USING (doc_id)""")
def null_safe(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", call_null_safe("UPPER", F.col("quality")).alias("up"), call_null_safe("CONCAT", F.col("lang"), F.col("toxic")).alias("tag"))
