"""Filters and predicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.operators.filters import apply_filter, matching_pairs, tagged_branches
from tablemill.operators.joins import join
from tablemill.operators.projection import calculate

ORDER = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
ORDER_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE "
PART = ("p_partkey", "p_name", "p_brand")
PART_SQL = "SELECT p_partkey, p_name, p_brand FROM part WHERE "
LABELLED_SQL = "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def orders_where(t: Tables, column: str, operator: str, value: object) -> DataFrame:
    return apply_filter(t.orders, {"column": column, "operator": operator, "value": value}).select(*ORDER)


def parts_where(t: Tables, column: str, operator: str, value: object) -> DataFrame:
    return apply_filter(t.part, {"column": column, "operator": operator, "value": value}).select(*PART)


def labelled(t: Tables) -> DataFrame:
    """Documents with labels that are null where a document has none."""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


def register_simple(name: str, column: str, operator: str, value: object, sql: str) -> None:
    query(name, ORDER_SQL + sql)(lambda t: orders_where(t, column, operator, value))


def register_text(name: str, column: str, operator: str, value: str, sql: str) -> None:
    query(name, PART_SQL + sql)(lambda t: parts_where(t, column, operator, value))


register_simple("flt_eq", "o_orderstatus", "=", "F", "o_orderstatus = 'F'")
register_simple("flt_ne", "o_orderstatus", "!=", "F", "o_orderstatus <> 'F'")
register_simple("flt_gt", "o_totalprice", ">", 250000, "o_totalprice > 250000")
register_simple("flt_lt", "o_orderdate", "<", "1997-01-01", "o_orderdate < TIMESTAMP '1997-01-01'")
register_simple("flt_ge", "o_totalprice", ">=", 250000.5, "o_totalprice >= 250000.5")
register_simple("flt_le", "o_orderdate", "<=", "1998-06-30 00:00:00", "o_orderdate <= TIMESTAMP '1998-06-30'")
register_simple("flt_in", "o_orderstatus", "IN", ["F", "P"], "o_orderstatus IN ('F', 'P')")
register_simple("flt_in_text_list", "o_orderstatus", "IN", "F, P", "o_orderstatus IN ('F', 'P')")
register_simple("flt_not_in", "o_orderstatus", "NOT IN", "F", "o_orderstatus NOT IN ('F')")
register_simple("flt_between", "o_totalprice", "BETWEEN", [100000, 200000], "o_totalprice BETWEEN 100000 AND 200000")
register_simple("flt_between_zero", "o_totalprice", "BETWEEN", {"min": 0, "max": 50000}, "o_totalprice BETWEEN 0 AND 50000")
register_simple("flt_between_text", "o_orderdate", "BETWEEN", "1996-01-01, 1996-12-31", "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
register_text("flt_like", "p_name", "LIKE", "red", "p_name LIKE '%red%'")
register_text("flt_ilike", "p_name", "ILIKE", "BO_T", "p_name ILIKE '%BO_T%'")
register_text("flt_contains", "p_brand", "CONTAINS", "#1", "contains(p_brand, '#1')")
register_text("flt_not_contains", "p_brand", "NOT_CONTAINS", "#1", "NOT contains(p_brand, '#1')")
register_text("flt_starts_with", "p_name", "STARTS_WITH", "blue", "starts_with(p_name, 'blue')")
register_text("flt_ends_with", "p_name", "ENDS_WITH", "bolt", "ends_with(p_name, 'bolt')")


@query("flt_is_null", LABELLED_SQL + " WHERE quality IS NULL")
def is_null(t: Tables) -> DataFrame:
    return apply_filter(labelled(t), {"column": "quality", "operator": "IS NULL"})


@query("flt_is_not_null", LABELLED_SQL + " WHERE quality IS NOT NULL")
def is_not_null(t: Tables) -> DataFrame:
    return apply_filter(labelled(t), {"column": "quality", "operator": "IS NOT NULL"})


@query("flt_null_rows_drop", LABELLED_SQL + " WHERE NOT (quality IN (1)) AND toxic <> 1")
def null_rows_drop(t: Tables) -> DataFrame:
    return apply_filter(labelled(t), [{"column": "quality", "operator": "NOT IN", "value": [1]},
                                      {"column": "toxic", "operator": "!=", "value": 1}])


@query("flt_and", ORDER_SQL + "o_orderstatus = 'O' AND o_totalprice > 300000 AND o_orderdate >= TIMESTAMP '1996-01-01'")
def all_of(t: Tables) -> DataFrame:
    spec = {"type": "logical", "operator": "AND", "expressions": [
        {"column": "o_orderstatus", "operator": "=", "value": "O"},
        {"column": "o_totalprice", "operator": ">", "value": "300000"},
        {"column": "o_orderdate", "operator": ">=", "value": "1996-01-01"}]}
    return apply_filter(t.orders, spec).select(*ORDER)


@query("flt_or", ORDER_SQL + "o_totalprice < 20000 OR (o_orderstatus = 'P' AND o_totalprice > 400000)")
def any_of(t: Tables) -> DataFrame:
    spec = {"type": "logical", "operator": "OR", "expressions": [
        {"column": "o_totalprice", "operator": "<", "value": 20000},
        {"type": "logical", "operator": "AND", "expressions": [
            {"column": "o_orderstatus", "operator": "=", "value": "P"},
            {"column": "o_totalprice", "operator": ">", "value": 400000}]}]}
    return apply_filter(t.orders, spec).select(*ORDER)


@query("flt_not", LABELLED_SQL + " WHERE NOT (quality = 1)")
def not_first(t: Tables) -> DataFrame:
    return apply_filter(labelled(t), {"type": "logical", "operator": "NOT", "expressions": [{"column": "quality", "operator": "=", "value": 1}]})


MIXED = [
    {"column": "o_orderstatus", "operator": "=", "value": "F"},
    {"column": "o_totalprice", "operator": ">", "value": 400000, "logicalOperator": "OR"},
    {"column": "o_orderdate", "operator": "<", "value": "1997-01-01", "logicalOperator": "AND"},
]


@query("flt_mixed_grouped", ORDER_SQL + "(o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01') OR o_totalprice > 400000")
def mixed_grouped(t: Tables) -> DataFrame:
    return apply_filter(t.orders, {"conditions": MIXED}).select(*ORDER)


@query("flt_mixed_sequential", ORDER_SQL + "o_orderstatus = 'F' OR o_totalprice > 400000 AND o_orderdate < TIMESTAMP '1997-01-01'")
def mixed_sequential(t: Tables) -> DataFrame:
    return apply_filter(t.orders, MIXED, "sequential").select(*ORDER)


@query("flt_mixed_all", ORDER_SQL + "o_orderstatus = 'F' AND o_totalprice > 400000 AND o_orderdate < TIMESTAMP '1997-01-01'")
def mixed_all(t: Tables) -> DataFrame:
    return apply_filter(t.orders, MIXED, "all").select(*ORDER)


@query("flt_func_ieq", PART_SQL + "upper(p_name) = upper('red Widget')")
def equal_ignoring_case(t: Tables) -> DataFrame:
    return apply_filter(t.part, {"type": "function", "function": "LOWER", "arguments": ["p_name"], "value": "red Widget"}).select(*PART)


@query("flt_expression", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 AND l_returnflag <> 'R'")
def free_expression(t: Tables) -> DataFrame:
    spec = {"mode": "expression", "expression": "l_extendedprice * (1 - l_discount) > 50000 AND l_returnflag <> 'R'"}
    return apply_filter(t.lineitem, spec).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("flt_typed_value", """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_linenumber IN (1, 3, 5) AND l_quantity >= 24 AND l_shipdate < TIMESTAMP '1999-06-17'""")
def typed_value(t: Tables) -> DataFrame:
    conditions = [{"column": "l_linenumber", "operator": "IN", "value": "1, 3,5"}, {"column": "l_quantity", "operator": ">=", "value": " 24 "},
                  {"column": "l_shipdate", "operator": "<", "value": "1999-06-17"}]
    return apply_filter(t.lineitem, conditions).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("flt_typed_wide", """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem
    WHERE l_linenumber < 3000000000 AND CAST(l_shipdate AS DATE) < TIMESTAMP '1996-03-05 12:00:00' AND CAST(l_shipdate AS DATE) > TIMESTAMP '1995-03-05 12:00:00'""")
def typed_wide(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return apply_filter(rows, [{"column": "l_linenumber", "operator": "<", "value": "3000000000"}, {"column": "day", "operator": "<", "value": "1996-03-05 12:00:00"},
                               {"column": "day", "operator": ">", "value": "1995-03-05 12:00:00"}])


@query("flt_bool_ops", "SELECT doc_id, quality, toxic = 1 AS is_toxic FROM labels WHERE (toxic = 1) = true")
def boolean_column(t: Tables) -> DataFrame:
    flagged = t.labels.select("doc_id", "quality", (F.col("toxic") == 1).alias("is_toxic"))
    return apply_filter(flagged, {"column": "is_toxic", "operator": "=", "value": "yes"})


@query("flt_mismatch_pairs", """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
    WHERE (c_mktsegment, c_nationkey) IN (VALUES ('BUILDING', 3), ('MACHINERY', 7), ('FURNITURE', 3))""")
def mismatch_pairs(t: Tables) -> DataFrame:
    pairs = [{"c_mktsegment": "BUILDING", "c_nationkey": 3}, {"c_mktsegment": "MACHINERY", "c_nationkey": 7},
             {"c_mktsegment": "FURNITURE", "c_nationkey": 3}]
    return matching_pairs(t.customer, "c_mktsegment", "c_nationkey", pairs).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("flt_calc_column", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem
    WHERE round(l_extendedprice * (1 - l_discount), 4) > 60000""")
def calculated_column(t: Tables) -> DataFrame:
    netted = calculate(t.lineitem, [{"name": "net", "expression": "round(l_extendedprice * (1 - l_discount), 4)"}])
    return apply_filter(netted, {"column": "net", "operator": ">", "value": 60000}).select("l_orderkey", "l_linenumber", "net")


@query("flt_post_join", """SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000""")
def after_join(t: Tables) -> DataFrame:
    joined = join(t.orders, t.customer, [{"leftColumn": "o_custkey", "rightColumn": "c_custkey"}])
    return apply_filter(joined, [{"column": "c_mktsegment", "operator": "=", "value": "BUILDING"},
                                 {"column": "o_totalprice", "operator": ">", "value": 200000}]).select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query("flt_branch_union", """SELECT 'early' AS branch, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
    UNION ALL SELECT 'large' AS branch, o_orderkey FROM orders WHERE o_totalprice > 300000""")
def branches(t: Tables) -> DataFrame:
    early, large = {"column": "o_orderdate", "operator": "<", "value": "1997-01-01"}, {"column": "o_totalprice", "operator": ">", "value": 300000}
    return tagged_branches(t.orders, {"early": early, "large": large}).select("branch", "o_orderkey")


@query("flt_mismatch_in_list", """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 0 AND
    ((c_mktsegment = 'BUILDING' AND c_nationkey = 3) OR (c_mktsegment = 'MACHINERY' AND c_nationkey = 7))""")
def mismatch_in_list(t: Tables) -> DataFrame:
    pairs = '[{"c_mktsegment": "BUILDING", "c_nationkey": "3"}, {"c_mktsegment": "MACHINERY", "c_nationkey": 7}]'
    spec = [{"column": "c_acctbal", "operator": ">", "value": 0}, {"column": "c_mktsegment", "operator": "MISMATCH", "value": pairs}]
    return apply_filter(t.customer, spec).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("flt_post_join_sides", """SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey
    WHERE a.s_acctbal > 5000 AND b.s_acctbal < 1000""")
def post_join_sides(t: Tables) -> DataFrame:
    joined = join(t.supplier, t.supplier, [{"leftColumn": "s_nationkey", "rightColumn": "s_nationkey"}], where=[
        {"column": "left.s_acctbal", "operator": ">", "value": 5000}, {"column": "right.s_acctbal", "operator": "<", "value": 1000}])
    return joined.select(F.col("_L_s_suppkey").alias("one"), F.col("_R_s_suppkey").alias("other"))
