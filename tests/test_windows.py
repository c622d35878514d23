import pytest
from pyspark.sql import functions as F

from tablemill.operators import ordering, windows
from tablemill.operators.windows import WindowError, window, with_position, with_read_order
from tests.conftest import rows

FUNCTIONS = [
    ("ROW_NUMBER", {}), ("RANK", {}), ("DENSE_RANK", {}), ("NTILE", {"buckets": 3}), ("NTILE", {"buckets": 500}), ("LAG", {"column": "v"}),
    ("LEAD", {"column": "v", "offset": 2}), ("LAG", {"column": "v", "offset": 3, "default": -1}), ("SUM", {"column": "v"}), ("AVG", {"column": "v"}),
    ("MIN", {"column": "v"}), ("MAX", {"column": "v"}), ("COUNT", {"column": "v"}), ("COUNT", {}),
]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with two thirds of the rows, a null key, ties and null values."""
    return spark.range(240).selectExpr(
        "id", "case when id % 3 < 2 then 'hot' when id % 7 = 0 then null else concat('k', id % 5) end as k",
        "if(id % 11 = 0, null, id % 13) as o", "if(id % 4 = 0, null, id % 17) as v").repartition(6).cache()


@pytest.mark.parametrize(("function", "extra"), FUNCTIONS)
def test_split_groups_agree_with_sparks_window(skewed, function, extra):
    unique = function in ("ROW_NUMBER", "NTILE", "LAG", "LEAD")
    order = [{"column": "o", "direction": "DESC"}] + ([{"column": "id"}] if unique else [])
    spec = {"function": function, "partition_by": ["k"], "order_by": order, "alias": "w", **extra}
    plain, split = window(skewed, spec, hot_rows=None), window(skewed, spec, hot_rows=60)
    assert plain.columns == split.columns
    assert rows(plain.withColumn("w", F.round("w", 6))) == rows(split.withColumn("w", F.round("w", 6)))


@pytest.mark.parametrize(("function", "extra"), FUNCTIONS)
def test_windows_without_partition(skewed, function, extra):
    order = [{"column": "o"}, {"column": "id", "direction": "DESC"}]
    spec = {"function": function, "order_by": order, "alias": "w", **extra}
    plain, split = window(skewed, spec, hot_rows=None), window(skewed, spec, hot_rows=80)
    assert rows(plain.withColumn("w", F.round("w", 6))) == rows(split.withColumn("w", F.round("w", 6)))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("frame", [(3, 0), (0, 4), (2, 2), (0, 0), (150, 90)])
@pytest.mark.parametrize("function", ["SUM", "MIN", "COUNT", "AVG"])
def test_frames_in_pieces_with_a_halo(skewed, keys, frame, function):
    spec = {"function": function, "column": "v", "partition_by": keys, "order_by": [{"column": "o"}, {"column": "id"}], "alias": "w", "frame": frame}
    plain, split = window(skewed, spec, hot_rows=None), window(skewed, spec, hot_rows=20)
    assert plain.columns == split.columns and plain.schema["w"].dataType == split.schema["w"].dataType
    assert rows(plain.withColumn("w", F.round("w", 6))) == rows(split.withColumn("w", F.round("w", 6)))


def test_no_task_has_more_than_a_piece_and_its_halo(skewed, monkeypatch):
    seen = []
    real = windows.Window.partitionBy
    monkeypatch.setattr(windows.Window, "partitionBy", lambda *names: (seen.append(len(names)), real(*names))[1])
    spec = {"function": "SUM", "column": "v", "partition_by": ["k"], "order_by": [{"column": "id"}], "alias": "w", "frame": (3, 0)}
    placed = windows._numbered(skewed, ["k"], [F.col("id")], 240, 20)
    assert window(skewed, spec, hot_rows=20).count() == 240 and 2 in seen
    copied = placed.withColumn("p", F.explode(F.sequence(F.floor((F.col(windows.PLACE) - 1) / 20), F.floor((F.col(windows.PLACE) + 2) / 20))))
    assert copied.groupBy("k", "p").count().agg(F.max("count")).first()[0] <= 23


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("function", ["SUM", "MAX", "COUNT"])
def test_whole_group_aggregates(skewed, keys, function):
    spec = {"function": function, "column": "v", "partition_by": keys, "alias": "w"}
    assert rows(window(skewed, spec, hot_rows=None)) == rows(window(skewed, spec, hot_rows=60))


def test_identical_rows_get_distinct_numbers(spark):
    same = spark.range(200).selectExpr("'x' as k", "1 as o").repartition(4)
    numbered = window(same, {"function": "ROW_NUMBER", "partition_by": ["k"], "order_by": [{"column": "o"}], "alias": "w"}, hot_rows=10)
    assert sorted(r.w for r in numbered.collect()) == list(range(1, 201))
    ranked = window(same, {"function": "RANK", "partition_by": ["k"], "order_by": [{"column": "o"}], "alias": "w"}, hot_rows=10)
    assert {r.w for r in ranked.collect()} == {1} and ranked.count() == 200


@pytest.mark.parametrize("function", ["SUM", "AVG", "MIN", "MAX", "COUNT"])
@pytest.mark.parametrize("kind", ["decimal(10,2)", "decimal(20,4)", "bigint", "int", "double"])
def test_both_paths_have_one_type(skewed, function, kind):
    df = skewed.withColumn("v", (F.col("v") + (9_000_000_000_000_000_000 if kind == "bigint" and function == "AVG" else 0)).cast(kind))
    spec = {"function": function, "column": "v", "partition_by": ["k"], "order_by": [{"column": "o"}], "alias": "w"}
    plain, split = window(df, spec, hot_rows=None), window(df, spec, hot_rows=60)
    assert plain.schema["w"].dataType == split.schema["w"].dataType
    if kind != "double":
        shown = [[(r.id, float(r.w) if r.w is not None else None) for r in x.orderBy("id").collect()] for x in (plain, split)]
        assert all(a[0] == b[0] and (a[1] == b[1] or abs(a[1] - b[1]) <= 1e-9 * abs(a[1])) for a, b in zip(*shown, strict=True))


def test_bad_specs(skewed):
    with pytest.raises(WindowError):
        window(skewed, {"function": "ROW_NUMBER", "partition_by": ["k"]})
    for wrong in ({"frame": (3, 0)}, {"frame": (-1, 0), "order_by": [{"column": "o"}]}, {"frame": (1, 1), "function": "LAG", "order_by": [{"column": "o"}]}):
        with pytest.raises(WindowError):
            window(skewed, {"function": "SUM", "column": "v", "partition_by": ["k"], **wrong})
    with pytest.raises(WindowError):
        window(skewed, {"function": "MEDIAN", "partition_by": ["k"], "order_by": [{"column": "o"}]})


def test_empty_input(skewed):
    spec = {"function": "RANK", "order_by": [{"column": "o"}], "alias": "w"}
    assert window(skewed.limit(0), spec).count() == 0
    assert window(skewed.limit(0), {**spec, "partition_by": ["k"]}).count() == 0


def test_positions(skewed):
    placed = with_position(skewed, [F.col("id").desc()], "p", hot_rows=30)
    assert rows(placed.select("p", "id")) == sorted(((i + 1, 239 - i) for i in range(240)), key=repr)


def test_read_order(spark, tmp_path):
    path = str(tmp_path / "lines.csv")
    with open(path, "w") as file:
        file.write("n\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    numbered = with_read_order(spark.read.csv(path, header=True), "row")
    assert all(int(r.n) + 1 == r.row for r in numbered.collect())


def test_far_pages_agree_with_near_ones(skewed, monkeypatch):
    keys = [{"column": "o", "direction": "desc"}, {"column": "id"}]
    near = [tuple(r) for r in ordering.page(skewed, keys, 3, 25).collect()]
    monkeypatch.setattr(ordering, "NEAR_ROWS", 10)
    assert [tuple(r) for r in ordering.page(skewed, keys, 3, 25).collect()] == near
    assert ordering.page(skewed, keys, 100, 25).count() == 0
    with pytest.raises(ValueError):
        ordering.page(skewed, keys, 0, 25)
    with pytest.raises(ValueError):
        ordering.page(skewed, keys, 1, 1001)


def test_sort_puts_nulls_last_ascending_and_first_descending(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r.a for r in ordering.sort(df, ["a"]).collect()] == [1, 2, None]
    assert [r.a for r in ordering.sort(df, [{"column": "a", "direction": "DESC"}]).collect()] == [None, 2, 1]


def test_distinct_rows_keep_the_first(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "n int, x string, y int")
    assert rows(ordering.distinct_rows(df, "n")) == [(1, "a", None), (3, "b", 1)]
    assert ordering.distinct_rows(df.drop("n")).count() == 2


def test_previews_are_bounded(spark):
    df = spark.range(500)
    assert ordering.preview(df).count() == 50 and ordering.preview(df, 100).count() == 100
    with pytest.raises(ValueError):
        ordering.preview(df, 101)


def test_top_k_uses_a_heap(spark, plan):
    assert "TakeOrderedAndProject" in plan(ordering.top_k(spark.range(10).toDF("id"), ["id"], 3))


@pytest.mark.parametrize("keys", [["v"], [{"column": "v", "direction": "desc"}], [{"column": "t", "direction": "desc"}, {"column": "v"}], ["t", {"column": "v", "direction": "desc"}]])
def test_indexed_pages_agree_with_plain_ones(spark, keys, monkeypatch):
    df = spark.range(400).selectExpr("id", "if(id % 7 = 0, null, cast(id % 23 as int)) as v", "if(id % 5 = 0, null, concat('t', cast(id % 3 as string))) as t")
    df = df.union(spark.range(150).selectExpr("1000L", "5", "'t1'"))  # a run of equal rows
    index = ordering.page_index(df, keys, ranges=7)
    spans = index.orderBy("range").collect()
    assert sum(s.n_rows for s in spans) == 550 and [s.rows_before for s in spans] == [sum(s.n_rows for s in spans[:i]) for i in range(len(spans))]
    plain = [tuple(r) for n in range(1, 16) for r in ordering.page(df, keys, n, 40).collect()]
    assert len(plain) == 550
    assert [tuple(r) for n in range(1, 16) for r in ordering.indexed_page(df, index, keys, n, 40).collect()] == plain
    monkeypatch.setattr(ordering, "NEAR_ROWS", 10)
    assert [tuple(r) for n in (6, 14) for r in ordering.indexed_page(df, index, keys, n, 40).collect()] == plain[200:240] + plain[520:]


def test_an_indexed_page_reads_its_ranges_only(spark, plan, tmp_path):
    spark.range(5000).selectExpr("id", "id * 3 as v").repartitionByRange(5, "v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    index = ordering.page_index(df, ["v"], ranges=20)
    shown = ordering.indexed_page(df, index, ["v"], 40, 100)
    assert [r.id for r in shown.collect()] == list(range(3900, 4000))
    assert "GreaterThanOrEqual(v,11250)" in plan(shown) and "LessThanOrEqual(v,12000)" in plan(shown)
    empty = df.limit(0)
    assert ordering.indexed_page(empty, ordering.page_index(empty, ["v"]), ["v"], 1, 10).count() == 0
    assert ordering.indexed_page(df, index, ["v"], 51, 100).count() == 0
    with pytest.raises(ValueError):
        ordering.indexed_page(df, index, ["v"], 0, 100)


def test_small_hot_rows_do_not_make_a_task_of_every_few_rows(spark):
    """Pieces are tasks: with groups cut at few rows there are no more of them than the session works on at once, or of PIECE_ROWS each."""
    assert windows._parts(spark.range(1), 1_000_000, 10) == windows._parts(spark.range(1), 1_000_000, 500) == 1_000_000 // windows.PIECE_ROWS
    assert windows._parts(spark.range(1), 100_000_000, 2_000_000) == 200
