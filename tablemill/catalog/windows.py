"""Windows, sorting, paging, distinct values and union."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.operators import ordering
from tablemill.operators.windows import window, window_expression
from tablemill.session import stage

BY_CUSTOMER = {"partition_by": ["o_custkey"], "order_by": [{"column": "o_orderdate", "direction": "DESC"}, {"column": "o_orderkey"}], "alias": "w"}
CUSTOMER_SQL = "SELECT o_orderkey, o_custkey, {} AS w FROM orders"
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey ASC NULLS LAST)"
BY_USER = {"partition_by": ["user_id"], "order_by": [{"column": "ts"}, {"column": "event_id"}], "alias": "w"}
USER_SQL = "SELECT event_id, user_id, {} AS w FROM events"
OVER_USER = "OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST)"


def by_customer(t: Tables, **spec: object) -> DataFrame:
    return window(t.orders, {**BY_CUSTOMER, **spec}).select("o_orderkey", "o_custkey", "w")


def by_user(t: Tables, **spec: object) -> DataFrame:
    return window(t.events, {**BY_USER, **spec}).select("event_id", "user_id", "w")


@query("win_row_number", CUSTOMER_SQL.format(f"row_number() {OVER}"))
def row_number(t: Tables) -> DataFrame:
    return by_customer(t, function="ROW_NUMBER")


@query("win_rank", "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus ASC NULLS LAST) AS w FROM orders")
def rank(t: Tables) -> DataFrame:
    return by_customer(t, function="RANK", order_by=[{"column": "o_orderstatus"}])


@query("win_dense_rank", "SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC NULLS FIRST) AS w FROM orders")
def dense_rank(t: Tables) -> DataFrame:
    return by_customer(t, function="DENSE_RANK", order_by=[{"column": "o_orderstatus", "direction": "desc"}])


@query("win_lag", USER_SQL.format(f"lag(value) {OVER_USER}"))
def lag(t: Tables) -> DataFrame:
    return by_user(t, function="LAG", column="value")


@query("win_lead", USER_SQL.format(f"lead(event_type, 2, 'none') {OVER_USER}"))
def lead(t: Tables) -> DataFrame:
    return by_user(t, function="LEAD", column="event_type", offset=2, default="none")


@query("win_ntile", USER_SQL.format(f"ntile(4) {OVER_USER}"))
def ntile(t: Tables) -> DataFrame:
    return by_user(t, function="NTILE", buckets=4)


@query("win_agg_over", CUSTOMER_SQL.format("round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 2)"))
def running_sum(t: Tables) -> DataFrame:
    result = by_customer(t, function="SUM", column="o_totalprice", order_by=[{"column": "o_orderstatus"}])
    return result.withColumn("w", F.round("w", 2))


@query("win_sum_decimal_hot", CUSTOMER_SQL.format("CAST(sum(CAST(o_totalprice AS DECIMAL(10,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS DECIMAL(20,2))"))
def sum_decimal_hot(t: Tables) -> DataFrame:
    spec = {**BY_CUSTOMER, "function": "SUM", "column": "price", "order_by": [{"column": "o_orderstatus"}]}
    return window(t.orders.withColumn("price", F.col("o_totalprice").cast("decimal(10,2)")), spec, hot_rows=10).select("o_orderkey", "o_custkey", "w")


@query("win_avg_bigint_hot", CUSTOMER_SQL.format("""CAST(round(CAST(sum(9000000000000000000 + CAST(o_orderkey AS HUGEINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS DOUBLE)
    / count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) / 1e6) AS DOUBLE)"""))
def avg_bigint_hot(t: Tables) -> DataFrame:
    spec = {**BY_CUSTOMER, "function": "AVG", "column": "large", "order_by": [{"column": "o_orderstatus"}]}
    rows = window(t.orders.withColumn("large", F.col("o_orderkey") + F.lit(9_000_000_000_000_000_000)), spec, hot_rows=10)
    return rows.select("o_orderkey", "o_custkey", F.round(F.col("w") / 1e6).alias("w"))


BY_TYPE = {"partition_by": ["event_type"], "order_by": [{"column": "ts"}, {"column": "event_id"}], "alias": "w"}
FRAME = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND {})"


@query("win_frame", f"SELECT event_id, event_type, CAST(sum(user_id) {FRAME.format(3, 'CURRENT ROW')} AS BIGINT) AS w FROM events")
def frame(t: Tables) -> DataFrame:
    return window(t.events, {**BY_TYPE, "function": "SUM", "column": "user_id", "frame": (3, 0)}).select("event_id", "event_type", "w")


@query("win_frame_hot", f"SELECT event_id, event_type, max(value) {FRAME.format(5, '2 FOLLOWING')} - min(value) {FRAME.format(3, 'CURRENT ROW')} AS w FROM events")
def frame_hot(t: Tables) -> DataFrame:
    """Two frames of hot groups, each in pieces with a halo, and an expression over both."""
    high = window(t.events, {**BY_TYPE, "function": "MAX", "column": "value", "frame": (5, 2), "alias": "high"}, hot_rows=500)
    both = window(high, {**BY_TYPE, "function": "MIN", "column": "value", "frame": (3, 0), "alias": "low"}, hot_rows=500)
    return both.select("event_id", "event_type", (F.col("high") - F.col("low")).alias("w"))


@query("win_lag_hot", "SELECT event_id, user_id, lag(value, 3, -1.0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS w FROM events")
def lag_hot(t: Tables) -> DataFrame:
    return window(t.events, {**BY_TYPE, "function": "LAG", "column": "value", "offset": 3, "default": -1.0}, hot_rows=500).select("event_id", "user_id", "w")


@query("win_agg_group", CUSTOMER_SQL.format("max(o_totalprice) OVER (PARTITION BY o_custkey)"))
def group_maximum(t: Tables) -> DataFrame:
    return by_customer(t, function="MAX", column="o_totalprice", order_by=[])


@query("win_row_number_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS w FROM orders")
def row_number_all(t: Tables) -> DataFrame:
    spec = {"function": "ROW_NUMBER", "order_by": [{"column": "o_totalprice", "direction": "DESC"}, {"column": "o_orderkey"}], "alias": "w"}
    return window(t.orders, spec).select("o_orderkey", "w")


@query("win_rank_all", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (ORDER BY l_quantity ASC NULLS LAST) AS w FROM lineitem")
def rank_all(t: Tables) -> DataFrame:
    spec = {"function": "RANK", "order_by": [{"column": "l_quantity"}], "alias": "w"}
    return window(t.lineitem, spec).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "w")


@query("win_expression", CUSTOMER_SQL.format("o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey)").replace(
    "FROM orders", "FROM orders QUALIFY o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) > 200000"))
def expression(t: Tables) -> DataFrame:
    above = window_expression(t.orders, "o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey)", "w")
    return above.filter(F.col("w") > 200000).select("o_orderkey", "o_custkey", "w")


@query("srt_one", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST")
def sort_one(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality")
    return ordering.sort(rows, [{"column": "quality", "direction": "desc"}])


@query("srt_node", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC")
def sort_several(t: Tables) -> DataFrame:
    keys = [{"column": "o_orderpriority"}, {"column": "o_totalprice", "direction": "desc"}]
    return ordering.sort(t.orders, keys).select("o_orderkey", "o_orderpriority", "o_totalprice")


PRICE_ORDER = [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}]


@query("lim_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 200")
def page(t: Tables) -> DataFrame:
    return ordering.page(t.orders.select("o_orderkey", "o_totalprice"), PRICE_ORDER, 3, 100)


LINE_ORDER = [{"column": "l_extendedprice", "direction": "desc"}, {"column": "l_orderkey"}, {"column": "l_linenumber"}, {"column": "l_partkey"}, {"column": "l_suppkey"}]


@query("lim_page_index", """WITH placed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC NULLS FIRST,
        l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM placed WHERE n BETWEEN 101 AND 200 OR n BETWEEN 4901 AND 5000""")
def indexed_pages(t: Tables) -> DataFrame:
    """Two pages, one of them far down, by one index."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    index = ordering.page_index(lines, LINE_ORDER, ranges=16)
    return ordering.indexed_page(lines, index, LINE_ORDER, 2, 100).unionAll(ordering.indexed_page(lines, index, LINE_ORDER, 50, 100))


@query("lim_page_summary", """SELECT count(*) AS total_count, CAST(ceil(count(*) / 100) AS BIGINT) AS total_pages, count(*) > 300 AS has_next, true AS has_previous,
    CAST(CASE WHEN count(*) > 200 THEN 201 ELSE 0 END AS BIGINT) AS showing_start, CAST(CASE WHEN count(*) > 200 THEN least(count(*), 300) ELSE 0 END AS BIGINT) AS showing_end
    FROM orders""")
def page_summary(t: Tables) -> DataFrame:
    return ordering.page_summary(t.orders, 3, 100)


@query("lim_preview", "SELECT least(count(*), 50) AS n, least(count(*), 50) AS known FROM orders")
def preview(t: Tables) -> DataFrame:
    """Which rows a preview has is open; all have to be rows of the table, none twice."""
    shown = stage(ordering.preview(t.orders), "preview")
    known = shown.distinct().join(t.orders, t.orders.columns, "left_semi")
    return shown.agg(F.count(F.lit(1)).alias("n")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))


@query("lim_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25")
def top_k(t: Tables) -> DataFrame:
    return ordering.top_k(t.orders.select("o_orderkey", "o_totalprice"), PRICE_ORDER, 25)


@query("dst_values", "SELECT DISTINCT CAST(p_brand AS VARCHAR) AS value FROM part WHERE p_brand IS NOT NULL ORDER BY 1 ")
def distinct_values(t: Tables) -> DataFrame:
    return ordering.distinct_values(t.part, "p_brand")


@query("dst_rows", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def distinct_rows(t: Tables) -> DataFrame:
    return ordering.distinct_rows(t.events.select("event_id", "user_id", "event_type"), "event_id")


@query("set_union_all", """SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier""")
def union_all(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return ordering.union([customers, t.supplier.select(F.col("s_nationkey").alias("nation"))])


@query("set_union", """SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION SELECT s_nationkey, NULL FROM supplier""")
def union_distinct(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return ordering.union([customers, t.supplier.select(F.col("s_nationkey").alias("nation"))], distinct=True)
