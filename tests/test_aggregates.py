import pytest

from tablemill.operators.aggregates import AUTO_GROUP, AggregateError, aggregate, aggregate_valid, check
from tests.conftest import rows


@pytest.fixture
def sales(spark):
    return spark.createDataFrame([("x", 1, 10), ("x", 1, None), ("y", 2, 5), (None, 2, 5)], "k string, g int, v int")


def total(**extra):
    return {"aggregateColumns": [{"function": "SUM", "column": "v", "alias": "s"}], **extra}


def test_null_group_and_order_of_keys(sales):
    found = aggregate(sales, total(groupByColumns=["g", "k"]))
    assert found.columns == ["g", "k", "s"]
    assert rows(found) == [(1, "x", 10), (2, "y", 5), (2, None, 5)]


def test_counts(sales):
    items = [{"function": "COUNT", "alias": "n"}, {"function": "COUNT", "column": "*", "alias": "m"}, {"function": "COUNT", "column": "v", "alias": "c"},
             {"function": "COUNT_DISTINCT", "column": "v", "alias": "d"}]
    assert rows(aggregate(sales, {"aggregateColumns": items})) == [(4, 4, 3, 2)]


def test_empty_input_gives_one_global_row(sales):
    assert rows(aggregate(sales.limit(0), total())) == [(None,)]
    assert aggregate(sales.limit(0), total(groupByColumns=["k"])).count() == 0


def test_group_precedence(sales):
    assert aggregate(sales, total(selectedColumns=["k"], groupByColumns=["g"])).columns == ["k", "s"]
    own = {"aggregateColumns": [{"function": "SUM", "column": "v", "alias": "s", "groupBy": ["g"]}, {"function": "MAX", "column": "v", "alias": "m", "groupBy": ["k", "g"]}]}
    assert aggregate(sales, own).columns == ["g", "k", "s", "m"]
    assert aggregate(sales, total(rules=[AUTO_GROUP], columns=["k", "s"])).columns == ["k", "s"]


def test_missing_group_columns(sales):
    with pytest.raises(AggregateError):
        aggregate(sales, total(groupByColumns=["k", "zzz"]))
    assert aggregate(sales, total(groupByColumns=["k", "zzz"]), on_missing="drop").columns == ["k", "s"]


def test_problems_are_listed(sales):
    found = check([{"function": "MEDIAN", "column": "v", "alias": "m"}, {"function": "COUNT_DISTINCT", "alias": "d"}, {"function": "SUM", "column": "w"},
                   {"function": "COUNT", "alias": "n"}], sales.columns)
    assert len(found) == 4
    with pytest.raises(AggregateError):
        aggregate(sales, {"aggregateColumns": [{"function": "SUM", "alias": "s"}]})


def test_having_and_filter(sales):
    spec = total(groupByColumns=["g"], filter={"column": "k", "operator": "IS NOT NULL"}, having=[{"column": "s", "operator": ">", "value": 5}])
    assert rows(aggregate(sales, spec)) == [(1, 10)]


def test_aggregates_partially_before_the_shuffle(sales, plan):
    assert "partial_sum" in plan(aggregate(sales, total(groupByColumns=["k"])))


def test_problems_as_rows(sales):
    column = sales.columns[0]
    good = {"groupByColumns": [column], "aggregateColumns": [{"function": "COUNT"}]}
    bad = {"groupByColumns": ["nowhere"], "aggregateColumns": [{"function": "MEDIAN", "column": column, "alias": "m"}]}
    results, report = aggregate_valid(sales, {"good": good, "bad": bad, "none": {"aggregateColumns": []}})
    assert set(results) == {"good", "none"} and rows(results["good"]) == rows(aggregate(sales, good))
    assert [(n, i) for n, i, _ in rows(report)] == [("bad", 1), ("bad", 2)]
    assert aggregate_valid(sales, {"good": good})[1].count() == 0
