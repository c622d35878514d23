"""Node-and-edge flows, and the flagship query."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.plans import graph
from tablemill.session import new_path, stage

SEGMENT_TOTALS = {
    "nodes": [
        {"id": "orders", "type": "source", "config": {"table": "orders"}},
        {"id": "customers", "type": "source", "config": {"table": "customer"}},
        {"id": "finished", "type": "filter", "config": {"conditions": [{"column": "o_orderstatus", "operator": "=", "value": "F"}]}},
        {"id": "slim", "type": "projection", "config": {"selectedColumns": ["o_custkey", "o_totalprice"]}},
        {"id": "joined", "type": "join", "config": {"joinType": "INNER", "conditions": [{"leftColumn": "o_custkey", "rightColumn": "c_custkey"}]}},
        {"id": "totals", "type": "aggregate", "config": {"groupByColumns": ["c_mktsegment"], "aggregateColumns": [
            {"function": "COUNT", "column": "*", "alias": "n_orders"}, {"function": "SUM", "column": "o_totalprice", "alias": "total"}]}},
        {"id": "report", "type": "destination", "config": {}},
    ],
    "edges": [
        {"source": "orders", "target": "finished"},
        {"source": "finished", "target": "slim"},
        {"source": "slim", "target": "joined", "targetHandle": "left"},
        {"source": "customers", "target": "joined", "targetHandle": "right"},
        {"source": "joined", "target": "totals"},
        {"source": "totals", "target": "report"},
    ],
}


@query("pip_run", """SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' GROUP BY c_mktsegment""")
def segment_totals(t: Tables) -> DataFrame:
    report = graph.run(SEGMENT_TOTALS, {"orders": t.orders, "customer": t.customer})["report"]
    return report.withColumn("total", F.round("total", 2))


BRANCHED = {
    "nodes": [
        {"id": "lines", "type": "source", "config": {"table": "lineitem", "whereClause": "l_quantity > 5"}},
        {"id": "priced", "type": "calculated", "config": {"columns": [{"name": "taxed", "expression": "net * (1 + l_tax)"},
                                                                       {"name": "net", "expression": "l_extendedprice * (1 - l_discount)"}]}},
        {"id": "returned", "type": "filter", "config": {"filter": {"column": "l_returnflag", "operator": "=", "value": "R"}}},
        {"id": "kept", "type": "filter", "config": {"filter": {"column": "l_returnflag", "operator": "!=", "value": "R"}}},
        {"id": "both", "type": "union", "config": {}},
        {"id": "sums", "type": "aggregation", "config": {"groupByColumns": ["l_returnflag"], "aggregateColumns": [
            {"function": "SUM", "column": "taxed", "alias": "taxed"}, {"function": "COUNT", "alias": "n"}]}},
        {"id": "sorted", "type": "sort", "config": {"keys": ["l_returnflag"]}},
        {"id": "sink", "type": "destination", "config": {"businessNames": {"l_returnflag": "flag"}}},
    ],
    "edges": [
        {"source": "lines", "target": "priced"}, {"source": "priced", "target": "returned"}, {"source": "priced", "target": "kept"},
        {"source": "returned", "target": "both"}, {"source": "kept", "target": "both"}, {"source": "both", "target": "sums"},
        {"source": "sums", "target": "sorted"}, {"source": "sorted", "target": "sink"},
    ],
}


@query("pip_branches", """SELECT l_returnflag AS flag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS taxed, count(*) AS n
    FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag""")
def branched(t: Tables) -> DataFrame:
    return graph.run(BRANCHED, {"lineitem": t.lineitem})["sink"].withColumn("taxed", F.round("taxed", 2))


@query("pip_load_modes", """SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier WHERE s_suppkey > 20
    UNION ALL SELECT c_custkey, CAST(c_acctbal AS DOUBLE) FROM customer WHERE c_custkey <= 20""")
def load_modes(t: Tables) -> DataFrame:
    """Suppliers replace what stood there before, then customers are upserted over the first of them."""
    path = new_path(t.spark, "flow")
    source = {"id": "in", "type": "source", "config": {"table": "rows"}}

    def load(rows: DataFrame, mode: str, **config: object) -> DataFrame:
        sink = {"id": "out", "type": "destination", "config": {"path": path, "loadMode": mode, **config}}
        return graph.run({"nodes": [source, sink], "edges": [{"source": "in", "target": "out"}]}, {"rows": rows})["out"]

    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("decimal(15,2)").alias("balance"))
    customers = t.customer.filter("c_custkey <= 20").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("decimal(15,2)").alias("balance"))
    load(customers, "insert")
    load(suppliers.unionByName(customers.limit(0)), "replace")
    return load(customers, "upsert", keyColumns=["id"])


@query("pip_preview", """SELECT least(count(*), 50) AS n, least(count(*), 50) AS known FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def preview(t: Tables) -> DataFrame:
    """All rows of a node's preview have to be rows of that node."""
    shown = stage(graph.preview(SEGMENT_TOTALS, {"orders": t.orders, "customer": t.customer}, "joined").select("o_totalprice", "c_custkey", "c_name"), "preview")
    node = t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_totalprice", "c_custkey", "c_name")
    known = shown.join(node.distinct(), node.columns, "left_semi")
    return shown.agg(F.count(F.lit(1)).alias("n")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))
