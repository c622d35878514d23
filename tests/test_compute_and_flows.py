import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators import compute
from tablemill.plans import graph
from tablemill.streaming.copy import copy_new_files
from tests.conftest import rows


@pytest.fixture
def events(spark):
    return spark.range(90).selectExpr("if(id < 60, 0, id % 3) as k", "id as v").repartition(4)


def stats(group):
    return pd.DataFrame({"k": [group.k.iloc[0]], "n": [len(group)], "s": [group.v.sum()]})


def merged(parts):
    return pd.DataFrame({"k": [parts.k.iloc[0]], "n": [parts.n.sum()], "s": [parts.s.sum()]})


def test_grouped_with_hot_groups(events):
    schema = "k bigint, n bigint, s bigint"
    plain = compute.compute_grouped(events, ["k"], stats, schema)
    split = compute.compute_grouped(events, ["k"], stats, schema, merged, max_rows=8)
    assert rows(plain) == rows(split)
    assert rows(compute.compute_grouped(events, ["k"], stats, schema, max_rows=8)) == rows(plain)  # without merge a group stays whole
    same = events.selectExpr("1L as k", "1L as v").coalesce(1)
    parts = compute.compute_grouped(same, ["k"], stats, schema, lambda p: p, max_rows=8)  # a merge that shows the parts
    assert parts.count() > 3 and sum(r.n for r in parts.collect()) == same.count() > max(r.n for r in parts.collect())


def test_small_parts_share_a_call_of_the_worker(spark, monkeypatch):
    """Many groups in parts of a few rows: a step sees what it would see alone, nulls and large numbers included, and Spark calls the worker for buckets."""
    table = spark.range(400).selectExpr("nullif(id % 97, 5) as k", "if(id % 11 = 0, null, 9007199254740993 + id) as v", "if(id % 7 = 0, null, id % 2 = 0) as b",
                                        "if(id % 13 = 0, null, id / 4) as x", "if(id % 5 = 0, null, concat('s', id)) as s", "date '2020-01-01' as d").repartition(5)

    def shown(part):
        return pd.DataFrame({"k": [None if pd.isna(part.k.iloc[0]) else int(part.k.iloc[0])], "n": [len(part)], "seen": [";".join(sorted(f"{c}:{t}" for c, t in part.dtypes.items()))],
                             "held": [str(sorted(map(str, part[["v", "b", "x", "s", "d"]].itertuples(index=False, name=None))))]}).astype({"k": object})

    def joined(parts):
        return pd.DataFrame({"k": [parts.k.iloc[0]], "n": [parts.n.sum()], "seen": [" ".join(sorted(parts.seen))], "held": [" ".join(sorted(parts.held))]})

    schema, calls = "k bigint, n bigint, seen string, held string", []
    cut = table.withColumn("__p", F.col("v") % 2)
    one_by_one = cut.groupBy("k", "__p").applyInPandas(shown, schema)
    real = compute._in_buckets
    assert rows(real(cut, ["k", "__p"], shown, T.StructType.fromDDL(schema), 3, 7)) == rows(one_by_one)
    monkeypatch.setattr(compute, "_in_buckets", lambda *a, **more: (calls.append(a[1]), real(*a, **more))[1])
    found = compute.compute_grouped(table, ["k"], shown, schema, joined, max_rows=3)
    assert sorted((r.k is None, r.k, r.n) for r in found.collect()) == sorted((r.k is None, r.k, r["count"]) for r in table.groupBy("k").count().collect())
    assert calls == [["k", "__part"], ["k", "__round"], ["k"]]


def test_batches_and_frames(events):
    assert compute.compute_batches(events, lambda b: b[b.v > 80], "k bigint, v bigint").count() == 9
    assert compute.compute_frame(events, lambda df: df.filter("v > 80")).count() == 9
    with pytest.raises(compute.ComputeError):
        compute.compute_frame(events, lambda df: 3)
    with pytest.raises(Exception, match="pandas DataFrame"):
        compute.compute_batches(events, lambda b: None, "k bigint").collect()


def test_output_check(events):
    after = events.selectExpr("k", "cast(null as int) as x")
    assert rows(compute.output_check(events, after, ["k", "y"])) == [("added", "x"), ("all_null", "x"), ("missing", "y"), ("removed", "v")]
    assert rows(compute.output_check(events, events.limit(0))) == [("empty", None)]
    assert rows(compute.output_check(events, events)) == []


def flow(*nodes, edges):
    return {"nodes": [{"id": i, "type": t, "config": c} for i, t, c in nodes], "edges": [dict(zip(("source", "target", "targetHandle"), e)) for e in edges]}


SOURCE = ("s", "source", {"table": "t"})


@pytest.mark.parametrize("spec", [
    flow(("f", "filter", {}), edges=[]),
    flow(SOURCE, ("f", "filter", {}), edges=[]),
    flow(SOURCE, ("j", "join", {}), edges=[("s", "j")]),
    flow(SOURCE, ("u", "union", {}), edges=[("s", "u")]),
    flow(SOURCE, ("x", "teleport", {}), edges=[("s", "x")]),
    flow(SOURCE, edges=[("s", "nowhere")]),
    flow(SOURCE, ("a", "union", {}), ("b", "filter", {}), edges=[("s", "a"), ("b", "a"), ("a", "b")]),
    flow(("s", "source", {"table": "unknown"}), edges=[]),
])
def test_invalid_flows(events, spec):
    with pytest.raises(graph.GraphError):
        graph.run(spec, {"t": events})


def test_all_node_types(spark, events):
    spec = flow(
        ("s", "source", {"table": "t", "whereClause": "v >= 10"}),
        ("cal", "calculated", {"columns": [{"name": "w", "expression": "v * 2"}]}),
        ("win", "window", {"function": "ROW_NUMBER", "partition_by": ["k"], "order_by": [{"column": "v"}], "alias": "rn"}),
        ("f", "filter", {"conditions": [{"column": "rn", "operator": "<=", "value": 3}]}),
        ("val", "validate", {"rules": [{"column": "w", "rule": "range", "min": 0, "max": 1000}]}),
        ("p", "projection", {"selectedColumns": ["k", "w"]}),
        ("c", "compute", {"columns": [{"alias": "kk", "expression": "k + 100"}]}),
        ("o", "sort", {"keys": [{"column": "w", "direction": "desc"}]}),
        ("l", "limit", {"rows": 4}),
        ("d", "destination", {"businessNames": {"kk": "Key", "k": "Key"}}),
        edges=[("s", "cal"), ("cal", "win"), ("win", "f"), ("f", "val"), ("val", "p"), ("p", "c"), ("c", "o"), ("o", "l"), ("l", "d")])
    out = graph.run(spec, {"t": lambda config: events})["d"]
    assert out.columns == ["Key", "w", "Key_2"]
    assert [tuple(r) for r in out.collect()] == [(2, 136, 102), (1, 134, 101), (2, 130, 102), (1, 128, 101)]


def test_left_and_right_handles(spark):
    a, b = spark.createDataFrame([(1, "a")], "x int, n string"), spark.createDataFrame([(1, "b")], "y int, m string")
    spec = flow(("a", "source", {"table": "a"}), ("b", "source", {"table": "b"}),
                ("j", "join", {"joinType": "LEFT", "conditions": [{"leftColumn": "x", "rightColumn": "y"}]}),
                edges=[("b", "j", "right"), ("a", "j", "left")])
    assert graph.run(spec, {"a": a, "b": b})["j"].columns == ["x", "n", "y", "m"]


def test_shared_nodes_can_be_staged(events):
    spec = flow(SOURCE, ("low", "filter", {"filter": {"column": "v", "operator": "<", "value": 10}}), ("high", "filter", {"filter": {"column": "v", "operator": ">", "value": 85}}),
                ("u", "union", {}), edges=[("s", "low"), ("s", "high"), ("low", "u"), ("high", "u")])
    assert graph.run(spec, {"t": events}, share="stage")["u"].count() == graph.run(spec, {"t": events})["u"].count() == 14


def test_preview(spark, events):
    assert graph.preview(flow(SOURCE, edges=[]), {"t": events}, "s").count() == 50
    with pytest.raises(graph.GraphError):
        graph.preview(flow(SOURCE, edges=[]), {"t": events}, "x")


def test_copy_continues_where_it_stopped(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    events = spark.range(20).toDF("v")
    events.repartition(3).write.parquet(source)
    step = lambda df: df.filter("v % 2 = 0").selectExpr("v", "v * 10 as w")
    copy_new_files(spark, source, target, events.schema, progress, files_per_batch=1, step=step)
    assert spark.read.parquet(target).count() == 10
    spark.range(20, 30).toDF("v").write.mode("append").parquet(source)
    copy_new_files(spark, source, target, events.schema, progress, step=step)
    assert rows(spark.read.parquet(target)) == sorted(((v, v * 10) for v in range(0, 30, 2)), key=repr)


def test_streamed_groups_come_in_batches(spark, events):
    def step(batches):
        key, n, total, largest = None, 0, 0, 0
        for batch in batches:
            key, n, total, largest = batch.k.iloc[0], n + len(batch), total + batch.v.sum(), max(largest, len(batch))
        yield pd.DataFrame({"k": [key], "n": [n], "s": [total], "largest": [largest]})

    schema = "k bigint, n bigint, s bigint, largest bigint"
    assert rows(compute.compute_streamed(events, ["k"], step, schema).drop("largest")) == rows(compute.compute_grouped(events, ["k"], stats, "k bigint, n bigint, s bigint"))
    hot = spark.range(200_000).selectExpr("id % 2 * 0 as k", "id as v")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        [found] = compute.compute_streamed(hot, ["k"], step, schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.n == 200_000 and found.largest <= 1000
    assert compute.compute_streamed(events.limit(0), ["k"], step, schema).count() == 0
    assert compute.compute_streamed(events, ["k"], lambda batches: iter([next(batches).head(1)]), "k bigint, v bigint").count() == 3
    with pytest.raises(Exception, match="pandas DataFrame"):
        compute.compute_streamed(events, ["k"], lambda batches: iter([3]), schema).collect()


@pytest.mark.parametrize("node", [{"type": "limit", "config": {"rows": 20}}, {"type": "calculated", "config": {"columns": [{"name": "r", "expression": "rand()"}]}},
                                  {"type": "filter", "config": {"filter": {"mode": "expression", "expression": "rand() < 0.5"}}}])
def test_branches_of_a_varying_node_agree(events, node, plan):
    spec = {"nodes": [{"id": "in", "type": "source", "config": {"table": "t"}}, {"id": "shared", **node}, {"id": "slim", "type": "projection", "config": {"selectedColumns": []}},
                      {"id": "one", "type": "filter", "config": {"filter": {"mode": "expression", "expression": "k >= 0"}}}, {"id": "two", "type": "filter", "config": {"filter": {"mode": "expression", "expression": "v >= 0"}}}],
            "edges": [{"source": "in", "target": "shared"}, {"source": "shared", "target": "slim"}, {"source": "slim", "target": "one"}, {"source": "slim", "target": "two"}]}
    found = graph.run(spec, {"t": events.repartition(7)})
    assert rows(found["one"]) == rows(found["two"]) == rows(found["one"])
    assert "/slim-" in plan(found["two"]) and "/shared-" not in plan(found["two"])  # written where it forks


def test_steady_nodes_are_planned_per_branch(events, plan):
    spec = {"nodes": [{"id": "in", "type": "source", "config": {"table": "t"}}, {"id": "sorted", "type": "sort", "config": {"keys": ["v"]}},
                      {"id": "one", "type": "filter", "config": {"filter": {"mode": "expression", "expression": "k = 0"}}}, {"id": "two", "type": "limit", "config": {"rows": 3}}],
            "edges": [{"source": "in", "target": "sorted"}, {"source": "sorted", "target": "one"}, {"source": "sorted", "target": "two"}]}
    found = graph.run(spec, {"t": events})
    assert "/sorted-" not in plan(found["one"]) and rows(found["two"]) == [(0, 0), (0, 1), (0, 2)]
