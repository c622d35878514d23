"""Aggregation. Sums and averages of doubles are rounded on both sides, because their last digits depend on the order of addition."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.operators.aggregates import AggregateError, AUTO_GROUP, aggregate, aggregate_valid, check
from tablemill.operators.filters import apply_filter
from tablemill.operators.ordering import union


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def measure(function: str, column: str, alias: str) -> dict:
    return {"function": function, "column": column, "alias": alias}


BY_FLAG = ["l_returnflag", "l_linestatus"]


def by_flag(t: Tables, *measures: dict) -> DataFrame:
    return aggregate(t.lineitem, {"groupByColumns": BY_FLAG, "aggregateColumns": list(measures)})


FLAG_SQL = "SELECT l_returnflag, l_linestatus, {} FROM lineitem GROUP BY l_returnflag, l_linestatus"


@query("agg_sum", FLAG_SQL.format("round(sum(l_extendedprice), 2) AS total, CAST(sum(l_linenumber) AS BIGINT) AS lines"))
def sums(t: Tables) -> DataFrame:
    return rounded(by_flag(t, measure("SUM", "l_extendedprice", "total"), measure("SUM", "l_linenumber", "lines")), ["total"])


@query("agg_avg", FLAG_SQL.format("round(avg(l_discount), 6) AS mean"))
def averages(t: Tables) -> DataFrame:
    return rounded(by_flag(t, measure("AVG", "l_discount", "mean")), ["mean"], 6)


@query("agg_min", FLAG_SQL.format("min(l_shipdate) AS first_ship"))
def minima(t: Tables) -> DataFrame:
    return by_flag(t, measure("MIN", "l_shipdate", "first_ship"))


@query("agg_max", FLAG_SQL.format("max(l_extendedprice) AS dearest"))
def maxima(t: Tables) -> DataFrame:
    return by_flag(t, measure("MAX", "l_extendedprice", "dearest"))


@query("agg_count_star", FLAG_SQL.format("count(*) AS n"))
def count_rows(t: Tables) -> DataFrame:
    return by_flag(t, measure("COUNT", "*", "n"))


@query("agg_count_col", "SELECT lang, count(quality) AS labelled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def count_values(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return aggregate(rows, {"groupByColumns": ["lang"], "aggregateColumns": [measure("COUNT", "quality", "labelled"), measure("COUNT", "", "n")]})


@query("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(t: Tables) -> DataFrame:
    return aggregate(t.events, {"groupByColumns": ["event_type"], "aggregateColumns": [measure("COUNT_DISTINCT", "user_id", "users")]})


@query("agg_stddev", FLAG_SQL.format("round(stddev_samp(l_quantity), 6) AS spread"))
def deviations(t: Tables) -> DataFrame:
    return rounded(by_flag(t, measure("STDDEV", "l_quantity", "spread")), ["spread"], 6)


@query("agg_variance", FLAG_SQL.format("round(var_samp(l_quantity), 6) AS variance"))
def variances(t: Tables) -> DataFrame:
    return rounded(by_flag(t, measure("VARIANCE", "l_quantity", "variance")), ["variance"], 6)


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders")
def whole_table(t: Tables) -> DataFrame:
    spec = {"aggregateColumns": [measure("COUNT", "*", "n"), measure("SUM", "o_totalprice", "total"), measure("MIN", "o_orderdate", "first_order"),
                                 measure("MAX", "o_orderdate", "last_order")]}
    return rounded(aggregate(t.orders, spec), ["total"])


@query("agg_group", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus")
def own_groups(t: Tables) -> DataFrame:
    spec = {"aggregateColumns": [{**measure("COUNT", "*", "n"), "groupBy": ["o_orderpriority"]},
                                 {**measure("SUM", "o_totalprice", "total"), "groupBy": ["o_orderpriority", "o_orderstatus"]}]}
    return rounded(aggregate(t.orders, spec), ["total"])


@query("agg_auto_group", "SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS richest FROM customer GROUP BY c_mktsegment, c_nationkey")
def auto_group(t: Tables) -> DataFrame:
    spec = {"columns": ["c_mktsegment", "c_nationkey", "richest"], "aggregateColumns": [measure("MAX", "c_acctbal", "richest")], "rules": [AUTO_GROUP]}
    return aggregate(t.customer, spec)


@query("agg_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) >= 10 AND max(o_totalprice) > 400000")
def having(t: Tables) -> DataFrame:
    spec = {"groupByColumns": ["o_custkey"], "aggregateColumns": [measure("COUNT", "*", "n"), measure("MAX", "o_totalprice", "top")],
            "having": [{"column": "n", "operator": ">=", "value": 10}, {"column": "top", "operator": ">", "value": 400000}]}
    return aggregate(t.orders, spec)


@query("agg_prefilter", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def prefilter(t: Tables) -> DataFrame:
    spec = {"groupByColumns": ["o_orderpriority"], "aggregateColumns": [measure("COUNT", "", "n")],
            "filter": [{"column": "o_orderstatus", "operator": "=", "value": "F"}]}
    return aggregate(t.orders, spec)


@query("agg_default_alias", "SELECT c_mktsegment, max(c_acctbal) AS MAX_c_acctbal, count(*) AS COUNT_1 FROM customer GROUP BY c_mktsegment")
def default_alias(t: Tables) -> DataFrame:
    return aggregate(t.customer, {"groupByColumns": ["c_mktsegment"], "aggregateColumns": [{"function": "MAX", "column": "c_acctbal"}, {"function": "COUNT"}]})


@query("agg_passthrough", "SELECT * FROM supplier")
def passthrough(t: Tables) -> DataFrame:
    return aggregate(t.supplier, {"groupByColumns": ["s_nationkey"], "aggregateColumns": []})


@query("agg_validate", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_brand")
def validated(t: Tables) -> DataFrame:
    """Of several aggregate lists, the first without problems is run."""
    candidates = [[measure("MEDIAN", "p_size", "m")], [measure("SUM", "", "s")], [measure("SUM", "weight", "w")], [{"function": "SUM", "column": "p_size"}],
                  [measure("SUM", "p_size", "sizes")]]
    part = t.part
    accepted = [c for c in candidates if not check(c, part.columns)]
    if len(accepted) != 1:
        raise AggregateError([f"{len(accepted)} lists accepted"])
    return aggregate(part, {"groupByColumns": ["p_brand"], "aggregateColumns": accepted[0]})


@query("agg_problems", """SELECT 'sums' AS name, p_brand, CAST(sum(p_size) AS BIGINT) AS sizes, NULL AS problem FROM part GROUP BY p_brand
    UNION ALL SELECT v.name, NULL, NULL, v.problem FROM (VALUES ('no column', 'SUM needs a source column'), ('other column', $$unknown source column 'weight'$$),
        ('other column', 'unknown grouping columns: shelf')) v(name, problem)""")
def problems_as_rows(t: Tables) -> DataFrame:
    """Of several configurations, the results of the valid ones and the problems of the others."""
    specs = {"no column": {"groupByColumns": ["p_brand"], "aggregateColumns": [measure("SUM", "", "s")]},
             "other column": {"groupByColumns": ["shelf"], "aggregateColumns": [measure("SUM", "weight", "w")]},
             "sums": {"groupByColumns": ["p_brand"], "aggregateColumns": [measure("SUM", "p_size", "sizes")]}}
    results, report = aggregate_valid(t.part, specs)
    found = [result.withColumn("name", F.lit(name)) for name, result in results.items()]
    return union([*found, report.drop("number")]).select("name", "p_brand", F.col("sizes").cast("bigint").alias("sizes"), "problem")


def pricing_summary(t: Tables) -> DataFrame:
    """Pricing summary over shipped lines: filter, calculated columns and eight aggregates in one scan and one shuffle."""
    shipped = apply_filter(t.lineitem, {"column": "l_shipdate", "operator": "<=", "value": "2000-09-02"})
    priced = shipped.withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    spec = {"groupByColumns": BY_FLAG, "aggregateColumns": [
        measure("SUM", "l_quantity", "sum_qty"), measure("SUM", "l_extendedprice", "sum_base"), measure("SUM", "net", "sum_net"),
        measure("AVG", "l_quantity", "avg_qty"), measure("AVG", "l_discount", "avg_disc"), measure("COUNT", "*", "n")]}
    return rounded(aggregate(priced, spec), ["sum_qty", "sum_base", "sum_net", "avg_qty", "avg_disc"])


query("agg_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_quantity), 2) AS avg_qty, round(avg(l_discount), 2) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""")(pricing_summary)
