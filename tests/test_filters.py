import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablemill.operators.filters import FilterError, apply_filter, branch_union, matching_pairs, tagged_branches
from tests.conftest import rows


def ids(df):
    return sorted(r.id for r in df.collect())


def where(column, operator, value=None, link=None):
    return {"column": column, "operator": operator, "value": value, **({"logicalOperator": link} if link else {})}


@pytest.mark.parametrize(("column", "operator", "value", "expected"), [
    ("a", "=", 1, [1]), ("a", "!=", 1, [3, 4, 6]), ("a", ">", 0, [1, 4, 6]), ("a", "<=", "1", [1, 3]),
    ("a", "IN", [0, 1], [1, 3]), ("a", "IN", "0, 1", [1, 3]), ("a", "IN", 1, [1]), ("a", "NOT IN", 1, [3, 4, 6]), ("a", "NOT IN", "0,1", [4, 6]),
    ("a", "BETWEEN", {"min": 0, "max": 1}, [1, 3]), ("a", "BETWEEN", {"from": 0, "to": 2}, [1, 3, 4]), ("a", "BETWEEN", "[1, 2]", [1, 4]),
    ("a", "BETWEEN", "1,2", [1, 4]), ("a", "IS NULL", None, [2, 5]), ("a", "IS NOT NULL", None, [1, 3, 4, 6]),
    ("b", "LIKE", "a", [1, 4]), ("b", "ILIKE", "a", [1, 4, 6]), ("b", "LIKE", "a_b", [4]), ("b", "CONTAINS", "%", [4]), ("b", "NOT_CONTAINS", "a", [2, 6]),
    ("b", "STARTS_WITH", "a%", [4]), ("b", "ENDS_WITH", "b", [2, 4]), ("a", "LIKE", "1", [1]),
])
def test_operators(null_logic, column, operator, value, expected):
    assert ids(apply_filter(null_logic, where(column, operator, value))) == expected


@pytest.mark.parametrize("spec", [
    where("a", "=", None), where("a", "=", ""), where("a", "BETWEEN", {"min": 1}), where("a", "BETWEEN", [1, None]), where("zzz", "=", 1), where("a", "~", 1),
    where("a", "=", "one"), where("a", "IN", []), where("a", "IN", [1, None]), {"type": "logical", "operator": "XOR", "expressions": [where("a", "=", 1)]},
    {"type": "logical", "operator": "AND", "expressions": []}, {"mode": "expression", "expression": "a + 1"},
])
def test_rejected_at_build_time(null_logic, spec):
    with pytest.raises(FilterError):
        apply_filter(null_logic, spec)


def test_not_keeps_unknown_out(null_logic):
    assert ids(apply_filter(null_logic, {"type": "logical", "operator": "NOT", "expressions": [where("a", "=", 1)]})) == [3, 4, 6]


def test_not_negates_the_first_expression(null_logic):
    spec = {"type": "logical", "operator": "NOT", "expressions": [where("a", "=", 1), where("a", "=", 3)]}
    assert ids(apply_filter(null_logic, spec)) == [3, 4, 6]


def test_group_of_one_is_kept(null_logic):
    assert ids(apply_filter(null_logic, {"type": "logical", "operator": "OR", "expressions": [where("a", "=", 1)]})) == [1]


def test_combination_modes(null_logic):
    mixed = [where("a", "=", 1), where("b", "=", "b", "OR"), where("id", ">", 1, "AND")]
    assert ids(apply_filter(null_logic, mixed)) == [2]
    assert ids(apply_filter(null_logic, [where("id", "<", 4), where("a", "=", 3, "OR"), where("a", "=", 1, "AND")])) == [1, 6]
    assert ids(apply_filter(null_logic, [where("id", "<", 4), where("a", "=", 3, "OR"), where("b", "=", "A", "AND")], "sequential")) == [1, 2, 3, 6]
    assert ids(apply_filter(null_logic, mixed, "all")) == []


def test_no_conditions_keep_everything(null_logic):
    for spec in (None, [], {}, {"conditions": []}):
        assert apply_filter(null_logic, spec).count() == 6


def test_boolean_columns_take_few_operators(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert ids(apply_filter(df, where("f", "=", "Yes"))) == [1]
    assert ids(apply_filter(df, where("f", "!=", "1"))) == [2]
    for operator, value in ((">", True), ("LIKE", "t"), ("IN", [True])):
        with pytest.raises(FilterError):
            apply_filter(df, where("f", operator, value))
    with pytest.raises(FilterError):
        apply_filter(df, where("f", "=", "perhaps"))


def test_dates_are_checked(spark):
    df = spark.sql("select 1 as id, timestamp_ntz'2024-03-05 00:00:00' as t, date'2024-03-05' as d")
    assert ids(apply_filter(df, where("t", "=", "2024-03-05"))) == [1]
    assert ids(apply_filter(df, where("d", "BETWEEN", ["2024-03-01", "2024-03-31"]))) == [1]
    with pytest.raises(FilterError):
        apply_filter(df, where("t", "=", "5.3.2024"))


def test_fraction_against_integer_column(null_logic):
    assert ids(apply_filter(null_logic, where("a", ">", 1.5))) == [4, 6]


def test_values_are_never_sql(null_logic):
    assert ids(apply_filter(null_logic, where("b", "=", "x' OR '1'='1"))) == []


def test_pairs(null_logic):
    found = matching_pairs(null_logic, "a", "b", [{"a": 1, "b": "a"}, {"a": 3, "b": "x"}, {"a": None, "b": "b"}])
    assert rows(found) == [(1, 1, "a")] and found.columns == ["id", "a", "b"]


def test_branch_union(null_logic):
    assert ids(branch_union(null_logic, [where("a", "=", 1), [where("b", "=", "b")]])) == [1, 2]
    assert branch_union(null_logic, [where("a", "=", 1), None]).count() == 6


def test_tagged_branches_read_once(null_logic, plan, spark, tmp_path):
    null_logic.write.parquet(str(tmp_path / "t"))
    tagged = tagged_branches(spark.read.parquet(str(tmp_path / "t")), {"x": where("a", "=", 1), "y": [where("a", ">=", 1)], "z": where("a", "=", 99)})
    assert sorted((r.branch, r.id) for r in tagged.collect()) == [("x", 1), ("y", 1), ("y", 4), ("y", 6)]
    text = plan(tagged)
    assert text.count("Location:") == 1 and "Exchange" not in text


def test_sides_and_mismatch(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 5, 4)], "_L_a int, _R_a int, b int")
    assert apply_filter(df, where("right.a", "=", 5)).count() == 1 and apply_filter(df, where("LEFT.a", "=", 1)).count() == 2
    assert apply_filter(df, where("orders.b", "=", 3)).count() == 1
    with pytest.raises(FilterError):
        apply_filter(df, where("left.c", "=", 1))
    assert apply_filter(df, where("b", "MISMATCH", [{"b": "3", "left.a": 1}])).count() == 1
    for bad in ("no json", [], [{"b": 1}], [{"b": 1, "_L_a": None}], [{"b": 1, "_L_a": 1}, {"b": 1, "_R_a": 1}]):
        with pytest.raises(FilterError):
            apply_filter(df, where("b", "MISMATCH", bad))


def test_literals_beyond_the_type(spark):
    df = spark.sql("select 1 as a, date'2024-01-01' as d union all select 2, date'2024-01-02' union all select null, null")
    counts = {("a", "<", 3_000_000_000): 2, ("a", ">", "-99999999999999999999"): 2, ("a", "=", 2**70): 0, ("d", "<", "2024-01-01 12:00:00"): 1, ("d", "<=", "2024-01-01 12:00:00"): 1,
              ("d", ">", "2024-01-01 12:00:00"): 1, ("d", ">=", "2024-01-01 00:00:00"): 2, ("d", "=", "2024-01-01 12:00:00"): 0, ("d", "!=", "2024-01-01 12:00:00"): 2}
    for (column, operator, value), n in counts.items():
        assert apply_filter(df, where(column, operator, value)).count() == n, (column, operator, value)


def test_pushed_to_the_scan(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 1.5 v").write.parquet(path)
    text = plan(apply_filter(spark.read.parquet(path), [where("id", ">", "90"), where("s", "IN", "91,92")]).select("id"))
    assert "GreaterThan(id,90)" in text and "In(s, [91,92])" in text and "v:" not in text.split("ReadSchema")[1].splitlines()[0]


cells = st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.sampled_from(["a", "b", "ab"])))
tests = st.one_of(
    st.tuples(st.just("a"), st.sampled_from(["=", "!=", "<", ">=", "IN", "NOT IN"]), st.integers(-3, 3)),
    st.tuples(st.just("b"), st.sampled_from(["=", "!=", "LIKE", "STARTS_WITH"]), st.sampled_from(["a", "b"])))


def brute(row, test):
    column, operator, value = test
    cell = row[0] if column == "a" else row[1]
    if cell is None:
        return None
    return {"=": cell == value, "!=": cell != value, "<": cell < value, ">=": cell >= value, "IN": cell == value, "NOT IN": cell != value,
            "LIKE": str(value) in str(cell), "STARTS_WITH": str(cell).startswith(str(value))}[operator]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cells, min_size=1, max_size=8), st.lists(st.tuples(tests, st.sampled_from(["AND", "OR"])), min_size=1, max_size=4))
def test_grouped_mode_by_brute_force(spark, table, conditions):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(table)], "id int, a int, b string")
    spec = [where(*test, link) for test, link in conditions]
    required = [t for i, (t, link) in enumerate(conditions) if i == 0 or link == "AND"]
    others = [t for i, (t, link) in enumerate(conditions) if i and link == "OR"]

    def kept(row):
        first = [brute(row, t) for t in required]
        both = False if False in first else (None if None in first else True)
        return both is True or any(brute(row, t) is True for t in others)

    assert ids(apply_filter(df, spec)) == [i for i, row in enumerate(table) if kept(row)]
