import pytest

from tablemill.operators.projection import ProjectionError, calculate, computed, include, project, rename_map, resolve_name
from tests.conftest import rows


@pytest.fixture
def pair(spark):
    return spark.createDataFrame([(1, 2), (3, None)], "a int, b int")


def test_calculated_columns_in_any_order(pair):
    found = calculate(pair, [{"name": "d", "expression": "c + a"}, {"name": "c", "expression": "a + b"}])
    assert rows(found.select("c", "d")) == [(3, 4), (None, None)]


def test_name_clashes(pair):
    found = calculate(pair, [{"name": "a", "expression": "99"}, {"name": "x", "expression": "1"}, {"name": "X", "expression": "2"}])
    assert found.columns == ["a", "b", "x"] and rows(found) == [(1, 2, 1), (3, None, 1)]


def test_cycles_and_unknown_columns(pair):
    with pytest.raises(ProjectionError):
        calculate(pair, [{"name": "x", "expression": "y + 1"}, {"name": "y", "expression": "x + 1"}])
    with pytest.raises(ProjectionError):
        calculate(pair, [{"name": "x", "expression": "nope"}])


def test_types_and_function_specs(pair):
    found = calculate(pair, [
        {"name": "t", "expression": "a", "dataType": "STRING"},
        {"name": "c", "expression": {"function": "CONCAT", "arguments": [{"column": "a"}, "-", {"function": "UPPER", "arguments": [{"column": "b"}]}]}},
    ])
    assert found.schema["t"].dataType.simpleString() == "string"
    assert rows(found.select("c")) == [("1-2",), ("3-",)]


def test_include_falls_back_to_all(pair):
    assert include(pair, ["zzz"]).columns == ["a", "b"]
    assert include(pair, ["b", "zzz", "b"]).columns == ["b"]


def test_join_names():
    columns = ["_L_x", "_R_x", "y", "_L_z"]
    assert resolve_name("x", columns) == ["_L_x", "_R_x"]
    assert resolve_name("x_r", columns) == ["_R_x"]
    assert resolve_name("z", columns) == ["_L_z"]
    assert resolve_name("y", columns) == ["y"] and resolve_name("q", columns) == []


def test_project(pair):
    assert project(pair, {"selectedMode": "EXCLUDE", "excludedColumns": ["a"]}).columns == ["b"]
    assert project(pair, {"columnOrder": ["b"]}).columns == ["b", "a"]
    assert project(pair, {"mapping": {"b": "B2"}}).columns == ["B2"]
    with pytest.raises(ProjectionError):
        rename_map(pair, {"q": "x"})


def test_computed_reads_the_input_only(pair):
    assert rows(computed(pair, [{"alias": "s", "expression": "a * 2"}])) == [(1, 2, 2), (3, None, 6)]
