import pytest
from pyspark.sql import functions as F

from tablemill.operators import joins
from tablemill.operators.joins import JoinError, join
from tests.conftest import rows

ON_ID = [{"leftColumn": "id", "rightColumn": "id"}]


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "l1"), (1, "l2"), (2, "l3"), (None, "l4"), (5, "l5")], "id int, name string")
    right = spark.createDataFrame([(1, "r1"), (3, "r3"), (None, "r4"), (2, "r2"), (2, "r5")], "id int, name string")
    return left, right


EXPECTED = {
    "INNER": [(1, "l1", 1, "r1"), (1, "l2", 1, "r1"), (2, "l3", 2, "r2"), (2, "l3", 2, "r5")],
    "LEFT": [(None, "l4", None, None), (5, "l5", None, None)],
    "RIGHT": [(None, None, 3, "r3"), (None, None, None, "r4")],
}
EXPECTED["FULL"] = EXPECTED["INNER"] + EXPECTED["LEFT"] + EXPECTED["RIGHT"]
EXPECTED["LEFT"] = EXPECTED["INNER"] + EXPECTED["LEFT"]
EXPECTED["RIGHT"] = EXPECTED["INNER"] + EXPECTED["RIGHT"]


@pytest.mark.parametrize("kind", list(EXPECTED))
@pytest.mark.parametrize(("hot_rows", "split_hot"), [(1, None), (1, True), (1000, True), (1, False)])
def test_null_and_repeated_keys(sides, kind, hot_rows, split_hot):
    found = join(*sides, ON_ID, kind, split_hot=split_hot, hot_rows=hot_rows)
    assert found.columns == ["_L_id", "_L_name", "_R_id", "_R_name"]
    assert rows(found) == sorted(EXPECTED[kind], key=repr)


def test_hot_key_is_spread(spark):
    """A key with most rows on both sides: the salted join finds every pair once."""
    left = spark.range(300).selectExpr("if(id < 200, 7, id) as k", "id as a")
    right = spark.range(60).selectExpr("if(id < 30, 7, id + 200) as k2", "id as b")
    keys = [{"leftColumn": "k", "rightColumn": "k2"}]
    for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
        assert rows(join(left, right, keys, kind, split_hot=True, hot_rows=10)) == rows(join(left, right, keys, kind, split_hot=False))


def test_identical_rows_keep_their_number(spark):
    left = spark.range(100).selectExpr("1 as k", "'same' as v").repartition(5)
    right = spark.range(3).selectExpr("1 as k2")
    assert join(left, right, [{"leftColumn": "k", "rightColumn": "k2"}], split_hot=True, hot_rows=7).count() == 300


def test_conditions_are_checked(sides):
    with pytest.raises(JoinError):
        join(*sides, [{"leftColumn": "nope", "rightColumn": "id"}])
    with pytest.raises(JoinError):
        join(*sides, [{"leftColumn": "id", "rightColumn": "id", "operator": "~"}])
    with pytest.raises(JoinError):
        join(*sides, ON_ID, output_columns=[{"column": "nope"}])


def test_theta_and_output(sides):
    conditions = [*ON_ID, {"leftColumn": "name", "rightColumn": "name", "operator": "!="}]
    outputs = [{"column": "name", "source": "right", "outputName": "other"}, {"column": "id", "source": "left"}, {"column": "name", "source": "left", "included": False}]
    found = join(*sides, conditions, output_columns=outputs)
    assert found.columns == ["other", "id"] and found.count() == 4


def test_filter_stays_above_an_outer_join(sides):
    found = join(*sides, ON_ID, "LEFT", where={"conditions": [{"column": "_R_name", "operator": "=", "value": "r1"}]})
    assert rows(found) == [(1, "l1", 1, "r1"), (1, "l2", 1, "r1")]


def test_cross_and_empty(sides, spark):
    left, right = sides
    assert join(left, right).count() == 25
    empty = left.limit(0)
    assert join(empty, right, ON_ID, "FULL", hot_rows=1).count() == 5
    assert join(empty, right, ON_ID, "INNER").count() == 0


def test_small_side_is_broadcast_and_no_cartesian_product(sides, plan):
    assert "CartesianProduct" not in plan(join(*sides))


def test_broadcast_needs_a_measured_bound(spark):
    from tablemill.session import fits_broadcast

    numbers = spark.range(100).toDF("n")
    assert fits_broadcast(numbers, rows=100) and not fits_broadcast(numbers, rows=99)
    texts = spark.range(10).selectExpr("repeat('x', 1000) as t")
    assert fits_broadcast(texts, size=20_000) and not fits_broadcast(texts, size=5_000)
    assert fits_broadcast(texts.limit(0))


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL"])
@pytest.mark.parametrize("mirrored", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_band_join_agrees_with_a_nested_loop(spark, kind, mirrored, strict):
    points = spark.sql("""select id as p, case when id % 13 = 0 then null when id = 14 then double('nan') when id = 15 then double('inf') when id = 16 then -double('inf')
        else (id * 37 % 101) - 40 + (id % 4) / 8 end as x from range(150)""")
    spans = spark.sql("""select id as s, case id when 3 then null when 4 then -double('inf') when 7 then -double('inf') when 8 then 200d else id * 3 % 89 - 45d end as lo,
        case id when 5 then null when 4 then double('inf') when 6 then double('nan') when 7 then -100d when 8 then double('inf') else id * 3 % 89 - 45d + pow(2, id % 14 - 6) * if(id % 9 = 0, 0, 1) - if(id % 17 = 0, 1, 0) end as hi from range(70)""")
    ops = (">", "<") if strict else (">=", "<=")
    turned = {">": "<", "<": ">", ">=": "<=", "<=": ">="}
    if mirrored:
        found = joins.join(spans, points, [{"leftColumn": c, "rightColumn": "x", "operator": turned[op]} for c, op in zip(("lo", "hi"), ops, strict=True)], kind)
    else:
        found = joins.join(points, spans, [{"leftColumn": "x", "rightColumn": c, "operator": op} for c, op in zip(("lo", "hi"), ops, strict=True)], kind)
    one, other = (spans, points) if mirrored else (points, spans)
    plain = one.join(other, F.expr(f"x {ops[0]} lo and x {ops[1]} hi"), joins.JOIN_TYPES[kind])
    assert found.columns == plain.columns
    assert rows(found.select("p", "s")) == rows(plain.select("p", "s"))


def test_band_join_has_no_nested_loop_and_bounded_copies(spark, plan):
    points = spark.range(4000).selectExpr("id as p", "timestamp_seconds(id * 977 % 100000) as x")
    spans = spark.range(3000).selectExpr("id as s", "timestamp_seconds(id * 31 % 100000) as lo", "timestamp_seconds(id * 31 % 100000 + cast(pow(3, id % 9) as int)) as hi")
    conditions = [{"leftColumn": "x", "rightColumn": "lo", "operator": ">="}, {"leftColumn": "x", "rightColumn": "hi", "operator": "<="}]
    found = joins.join(points, spans, conditions)
    assert "NestedLoop" not in plan(found) and "CartesianProduct" not in plan(found)
    assert found.count() == points.join(spans, F.expr("x between lo and hi")).count()
    assert joins.join(points.limit(0), spans, conditions).count() == 0 and joins.join(points, spans.limit(0), conditions, "LEFT").count() == 4000
    both = joins.join(points, points.withColumnRenamed("x", "y"), [{"leftColumn": "p", "rightColumn": "p"}, *[{"leftColumn": "x", "rightColumn": "y", "operator": op} for op in (">=", "<=")]])
    assert both.count() == 4000


@pytest.mark.parametrize("kind", ["INNER", "FULL"])
def test_crowded_bins_are_cut_into_blocks(spark, kind, monkeypatch, plan):
    """Most points and spans in one bin: every pair is found once, no side is broadcast, and pairs are not written."""
    points = spark.range(300).selectExpr("id as p", "if(id < 200, 5d, id / 10) as x").repartition(3)
    spans = spark.range(90).selectExpr("id as s", "if(id < 60, 4d, id + 0d) as lo", "if(id < 60, 6.5d, id + id % 3) as hi")
    conditions = [{"leftColumn": "x", "rightColumn": "lo", "operator": ">="}, {"leftColumn": "x", "rightColumn": "hi", "operator": "<"}]
    staged, real = [], joins.stage
    monkeypatch.setattr(joins, "stage", lambda df, label: (staged.append(label), real(df, label))[1])
    monkeypatch.setattr(joins.band_join, "__defaults__", (7,))
    found = joins.join(points, spans, conditions, kind)
    shown = plan(found)
    assert rows(found) == rows(points.join(spans, F.expr("x >= lo and x < hi"), joins.JOIN_TYPES[kind]))
    assert "NestedLoop" not in shown and "band" not in staged and "SortMergeJoin" in shown
    band = joins.find_band(points, spans, [("x", "lo", ">="), ("x", "hi", "<")])
    for side in joins._blocks(points, spans, band, 7):
        assert side.groupBy("__level", "__bin", "__point_part", "__span_part").count().agg(F.max("count")).first()[0] < 60


@pytest.mark.parametrize("many", ["points", "spans"])
def test_the_larger_side_of_a_band_stands_in_one_bin(spark, many):
    """Few rows are copied to the bins of many, whichever side they are: spans of four lengths don't copy the points, nor points the spans."""
    n_points, n_spans = (4000, 30) if many == "points" else (30, 4000)
    points = spark.range(n_points).selectExpr("id as p", "id * 37 % 1000 + 0.5d as x")
    spans = spark.range(n_spans).selectExpr("id as s", "id * 53 % 1000 + 0d as lo", "id * 53 % 1000 + 3 * pow(4, id % 4) as hi")
    sides = joins._blocks(points, spans, joins.Band("x", "lo", "hi", True), joins.BLOCK_ROWS)
    assert max(side.count() for side in sides) <= 4000 + 30 and min(side.count() for side in sides) < 3000
    found = joins.join(points, spans, [{"leftColumn": "x", "rightColumn": "lo", "operator": ">="}, {"leftColumn": "x", "rightColumn": "hi", "operator": "<"}])
    assert rows(found.select("p", "s")) == rows(points.join(spans, F.expr("x >= lo and x < hi")).select("p", "s"))


def test_grids_cover_every_length_once():
    for levels in ([3], [-20, 17, 18], [*range(-5, 40)], [-40, 0, 900]):
        for rows_of in (lambda n: 1, lambda n: 10**6, lambda n: 7**n % 10**5 if n > 0 else 5):
            lengths = [joins._Length(n, rows_of(n), 2.0**n * 0.8) for n in levels]
            for points in (1, 1000, 10**8):
                grids = joins._grids(lengths, points, 1e6, -40, joins.BLOCK_ROWS, 64)
                assert [sum(g.shortest <= n <= g.longest for g in grids) for n in levels] == [1] * len(levels)
                for g in grids:
                    assert -40 <= g.level <= g.shortest and (not g.before or g.before * 2.0**g.level >= max(x.most for x in lengths if x.level <= g.longest))


@pytest.mark.parametrize("kind", ["LEFT", "RIGHT", "FULL"])
def test_outer_band_join_looks_for_each_compared_value_once(spark, kind, monkeypatch):
    """Rows without a match are found by the values they are compared by: 6 points' and 5 spans' here, nulls aside, whatever the number of rows."""
    points = spark.range(700).selectExpr("id as p", "if(id % 7 = 6, null, if(id % 7 = 5, double('nan'), id % 7 + 0.5d)) as x", "if(id % 7 = 6, 'a', 'b') as t")
    spans = spark.range(600).selectExpr("id as s", "if(id % 6 = 5, null, id % 6 * 2d) as lo", "if(id % 6 = 5, 9d, id % 6 * 2 + 1d) as hi", "'b' as u")
    conditions = [{"leftColumn": a, "rightColumn": b, "operator": op} for a, b, op in (("x", "lo", ">="), ("x", "hi", "<"), ("t", "u", "<="))]
    staged, real = [], joins.stage
    monkeypatch.setattr(joins, "stage", lambda df, label: (staged.append((label, real(df, label))), staged[-1][1])[1])
    found = joins.join(points, spans, conditions[:2], kind)
    assert rows(found.select("p", "s")) == rows(points.join(spans, F.expr("x >= lo and x < hi"), joins.JOIN_TYPES[kind]).select("p", "s"))
    assert [df.count() for label, df in staged if label == "values"] == [6, 5]
    assert all(df.count() <= 6 for label, df in staged if label == "matched")
    found = joins.join(points, spans, conditions, kind).select("p", "s")
    assert rows(found) == rows(points.join(spans, F.expr("x >= lo and x < hi and t <= u"), joins.JOIN_TYPES[kind]).select("p", "s"))


def test_blocks_of_a_crowded_bin_grow_with_the_input(spark):
    """One hot value and spans that all hold it: four times the rows are copied to about four times as many, not sixteen times; each pair still meets once."""
    def sides(n):
        points = spark.range(4 * n).selectExpr("id as p", "if(id % 4 = 0, id + 0d, 5d) as x")
        spans = spark.range(2 * n).selectExpr("id as s", "4d as lo", "if(id % 3 = 0, 6d, 5.5d) as hi")
        return joins._blocks(points, spans, joins.Band("x", "lo", "hi", True), 2)

    small, large = ([side.count() for side in sides(n)] for n in (100, 400))
    assert sum(large) < 6 * sum(small)
    points, spans = sides(400)
    block = [f"__{c}" for c in joins._BLOCK]
    met = points.join(spans, block).filter("x >= lo and x < hi")
    assert met.count() == met.select("p", "s").distinct().count() == 1201 * 800  # the hot ones, and the point at 4
    assert points.groupBy(block).count().count() >= 8  # enough for every core to have some


@pytest.mark.parametrize("kind", ["INNER", "FULL"])
def test_band_join_with_more_bins_than_a_broadcast_holds(spark, kind, monkeypatch):
    """Only the bins that are cut are looked up then, and rows of the others pass."""
    points = spark.range(400).selectExpr("id as p", "if(id < 200, 5d, id / 4) as x").repartition(3)
    spans = spark.range(120).selectExpr("id as s", "if(id < 60, 4d, id + 0d) as lo", "if(id < 60, 6.5d, id + id % 3) as hi")
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(joins.band_join, "__defaults__", (7,))
    staged, real = [], joins.stage
    monkeypatch.setattr(joins, "stage", lambda df, label: (staged.append((label, real(df, label))), staged[-1][1])[1])
    found = joins.join(points, spans, [{"leftColumn": "x", "rightColumn": "lo", "operator": ">="}, {"leftColumn": "x", "rightColumn": "hi", "operator": "<"}], kind)
    assert rows(found) == rows(points.join(spans, F.expr("x >= lo and x < hi"), joins.JOIN_TYPES[kind]))
    bins, crowded = (next(df for label, df in staged if label == name).count() for name in ("bins", "crowded"))
    assert 0 < crowded < bins
