import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablemill.operators import table_changes as change
from tablemill.session import new_path, work_dir
from tablemill.sinks import export, tables
from tablemill.sources import files, jdbc
from tablemill.types import spark_type
from tests.conftest import rows


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")


def read(spark, path):
    return spark.read.parquet(path)


def test_load_modes(spark, base, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(base, path)
    tables.write_table(spark.createDataFrame([("c", 3)], "v string, id int"), path)
    assert rows(read(spark, path)) == [(1, "a"), (2, "b"), (3, "c")] and read(spark, path).schema["id"].dataType.simpleString() == "bigint"
    tables.write_table(spark.createDataFrame([("d", 4)], "v string, id int"), path, "replace")
    assert rows(read(spark, path)) == [(4, "d")] and read(spark, path).columns == ["id", "v"]
    with pytest.raises(tables.SinkError):
        tables.write_table(spark.createDataFrame([("e",)], "w string"), path)
    assert rows(read(spark, path)) == [(4, "d")]
    tables.write_table(spark.createDataFrame([("e",)], "w string"), path, on_mismatch="recreate")
    assert rows(read(spark, path)) == [("e",)]
    with pytest.raises(tables.SinkError):
        tables.write_table(base, path, on_mismatch="replace")
    with pytest.raises(tables.SinkError):
        tables.write_table(base, path, "merge")


def test_upsert(spark, base):
    updates = spark.createDataFrame([(2, "B1", 1), (2, "B2", 2), (3, "C", 1)], "id int, v string, n int")
    assert rows(tables.upserted(base, updates, ["id"], "n")) == [(1, "a"), (2, "B2"), (3, "C")]
    assert rows(tables.upserted(base, updates.filter("n = 1"), ["id"])) == [(1, "a"), (2, "B1"), (3, "C")]
    with pytest.raises(Exception, match="updated twice"):
        tables.upserted(base, updates, ["id"]).collect()
    assert rows(tables.upserted(base, updates.limit(0), ["id"], "n")) == [(1, "a"), (2, "b")]
    unordered = spark.createDataFrame([(1, "new", None), (2, "old", None), (2, "last", 5)], "id int, v string, n int")
    assert rows(tables.upserted(base, unordered, ["id"], "n")) == [(1, "new"), (2, "last")]


def test_append_reads_one_date_format_per_column(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    spark.sql("select 7L as __id, 'x' as key, date'2024-01-01' as day").write.parquet(path)
    days = [(2, "a", "13/04/2024"), (3, "b", "03/04/2024"), (4, " ", None), (5, "a", "13/04/2024"), (6, "c", "25/12/2024")]
    assert tables.append_checked(spark.createDataFrame(days, "n int, key string, day string"), path, "n", log).isEmpty()
    assert [(r["__id"], r.key, str(r.day)) for r in read(spark, path).orderBy("__id").collect()] == [
        (7, "x", "2024-01-01"), (8, "a", "2024-04-13"), (9, "b", "2024-04-03"), (10, "c", "2024-12-25")]
    assert [tuple(r)[2:] for r in read(spark, log).collect()] == [(5, 2, 3, 0)]


def test_business_names(base):
    assert tables.business_names(["a", "b", "c", "d"], {"a": "X", "b": "X", "c": "X"}) == {"a": "X", "b": "X_2", "c": "X_3", "d": "d"}
    labelled = base.withMetadata("v", {"business_name": "Value"})
    assert tables.with_business_names(labelled).columns == ["id", "Value"]


def test_system_columns(spark, base):
    named = base.withColumnRenamed("id", "key")
    assert rows(tables.with_system_columns(named, ["v"])) == [(1, 1, "a", True), (2, 2, "b", True)]
    assert tables.with_system_columns(named).select("__id").distinct().count() == 2
    with pytest.raises(tables.SinkError):
        tables.with_system_columns(base)


def test_append_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select 1L as key, 1.5d as price, date'2024-01-01' as day, true as __active").write.parquet(path)
    bad = spark.createDataFrame([(2, "2", "x", "31.12.2024"), (3, "y", "z", None), (4, "4", None, "never")], "n int, KEY string, Price string, day string")
    rejects = tables.append_checked(bad, path, "n")
    assert rows(rejects) == [(2, "2", "price", "x"), (3, "y", "key", "y"), (3, "y", "price", "z")]
    assert read(spark, path).count() == 1
    good = spark.createDataFrame([(2, "2E0", "1.25E1", "31.12.2024"), (3, "3", None, "never")], "n int, KEY string, Price string, day string")
    assert tables.append_checked(good, path, "n").isEmpty()
    assert [(r.key, r.price, str(r.day), r["__active"]) for r in read(spark, path).orderBy("key").collect()] == [
        (1, 1.5, "2024-01-01", True), (2, 12.5, "2024-12-31", True), (3, None, "None", True)]
    with pytest.raises(tables.SinkError):
        tables.append_checked(good.withColumnRenamed("KEY", "extra"), path, "n")
    with pytest.raises(tables.SinkError):
        tables.append_checked(good, str(tmp_path / "missing"), "n")


def test_export_round_trip(spark, tmp_path):
    df = spark.sql("""select 1 as n, 'a,"b"' as s, timestamp_ntz'2024-01-02 00:00:00' as t, true as f union all
        select 2, '', timestamp_ntz'2024-01-02 10:30:00', false union all select 3, null, null, null""")
    out = export.export_rows(df, order=["n"], date_format="DD-MM-YY")
    expected = [("1", 'a,"b"', "02-01-24", "True"), ("2", "", "02-01-24 10:30:00", "False"), ("3", "None", "None", "None")]
    assert [tuple(r) for r in out.collect()] == expected
    export.write_csv(out, str(tmp_path / "c"))
    back = rows(files.read_csv(spark, str(tmp_path / "c"), missing=()))
    assert [tuple("" if v is None else v for v in r) for r in back] == expected
    export.write_tsv(out.select("n", "t"), str(tmp_path / "d"))
    lines = [line for part in sorted((tmp_path / "d").glob("part*")) for line in part.read_text().splitlines() if not line.startswith("n\t")]
    assert lines == ["1\t02-01-24", "2\t02-01-24 10:30:00", "3\tNone"]


def test_date_pattern():
    assert export.date_pattern("YYYY-MM-DD HH:mm:SS") == "yyyy-MM-dd HH:mm:ss" and export.date_pattern("DD of MM") == "dd 'of' MM"


def test_plain_values(spark):
    df = spark.sql("select cast(1.25 as decimal(5,2)) d, timestamp_ntz'2024-01-02 03:04:05.5' t, date'2024-01-02' y, cast('x' as binary) b, unhex('FF00') r, 1 i")
    assert rows(export.plain_values(df)) == [(1.25, "2024-01-02T03:04:05.500000", "2024-01-02", "x", "/wA=", 1)]


def test_csv_missing_markers(spark, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,NA\nNone,"x, ""y"""\n')
    assert rows(files.read_csv(spark, str(tmp_path / "f.csv"))) == [("1", None), (None, 'x, "y"')]


def test_branches(spark, base, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    tables.write_branches(base, {one: lambda df: df.filter("id = 1"), two: lambda df: df})
    assert rows(read(spark, one)) == [(1, "a")] and read(spark, two).count() == 2


def test_work_folder(spark):
    assert work_dir(spark) == work_dir(spark) and new_path(spark, "x") != new_path(spark, "x")


def test_table_changes(spark, base):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "7")], "id int, v string")
    assert rows(change.delete_rows(df, [{"column": "v", "operator": "=", "value": "x"}])) == [(1, None), (3, "7")]
    assert change.delete_rows(df).count() == 0 and rows(change.deleted_count(df)) == [(3,)]
    assert rows(change.retype_column(df, "v", "INTEGER", strict=False)) == [(1, None), (2, None), (3, 7)]
    assert rows(change.retype_loss(df, "v", "INTEGER")) == [("x", 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        change.retype_column(df, "v", "INTEGER").collect()
    for attempt in (lambda: change.drop_column(df, "__id"), lambda: change.rename_column(df, "id", "__active"), lambda: change.add_column(df, "V", "TEXT"),
                    lambda: change.drop_column(df, "zzz"), lambda: change.rename_column(df, "id", "V"), lambda: change.retype_column(df, "__id", "TEXT")):
        with pytest.raises(change.ChangeError):
            attempt()


def test_type_names():
    assert spark_type("varchar(20)") == "string" and spark_type("numeric(10,2)") == "decimal(10,2)" and spark_type("Double  Precision") == "double"
    with pytest.raises(ValueError):
        spark_type("geometry")


@pytest.mark.parametrize(("kind", "url", "table"), [
    ("postgresql", "jdbc:postgresql://h:5432/d", '"s"."t""x"'), ("mysql", "jdbc:mysql://h:3306/d", '`s`.`t"x`'), ("oracle", "jdbc:oracle:thin:@//h:1521/d", '"s"."t""x"'),
    ("sqlserver", "jdbc:sqlserver://h:1433;databaseName=d", '[s].[t"x]'), ("hana", "jdbc:sap://h:30015/?databaseName=d", '"s"."t""x"')])
def test_jdbc_options(kind, url, table):
    connection = jdbc.Connection(kind, "h", "d", "me", "secret")
    options = jdbc.read_options(connection, 't"x', "s")
    assert (options["url"], options["dbtable"], options["fetchsize"], options["user"]) == (url, table, "10000", "me")
    assert "secret" not in repr(connection)
    assert jdbc.write_options(connection, "t", replace=True)["truncate"] == "true" and "truncate" not in jdbc.write_options(connection, "t")


def test_jdbc_chunks():
    assert jdbc.chunk_options("id", 1, 100, 10, 95) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "10"}
    assert jdbc.chunk_options("id", 1, 1, 10_000, 0)["numPartitions"] == "1"
    with pytest.raises(ValueError):
        jdbc.Connection("db2", "h", "d")


def test_ranges_follow_the_keys(spark):
    """Every row meets one condition, and ranges are even where keys are dense, gappy, repeated or null."""
    frame = spark.range(20_000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id < 15000 THEN id ELSE id * id END AS gappy", "CASE WHEN id < 8000 THEN 7 ELSE id END AS heavy",
        "date_add(DATE '2020-01-01', CAST(sqrt(id) AS INT)) AS day", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, pow(id, 1.5)) AS moment",
        "CAST(id AS DECIMAL(20, 2)) / 7 AS part", "id / 3.0e0 AS number")
    for column in frame.columns:
        bounds, nulls = jdbc.key_bounds(frame, column, 1000)
        conditions = jdbc.range_predicates(f"`{column}`", bounds, nulls)
        counts = frame.agg(*[F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(conditions)]).first()
        assert sum(counts) == 20_000 and nulls == (column == "gappy"), column
        assert sorted(counts)[-2] < 1300 and max(counts) < (9_300 if column == "heavy" else 1300), (column, counts)
    assert jdbc.key_bounds(frame, "gappy", 50_000) == ([], True) and jdbc.key_bounds(frame.limit(0), "gappy") == ([], False)
    assert jdbc.range_predicates("k", [], True) == ["k IS NOT NULL", "k IS NULL"]
    with pytest.raises(ValueError):
        jdbc.key_bounds(frame.selectExpr("CAST(gappy AS STRING) AS text"), "text")


def test_range_literals():
    moment = dt.datetime(2024, 1, 5, 10, 11, 12, 500000)
    assert jdbc.range_predicates("[k]", [moment], False, "sqlserver") == ["[k] < '2024-01-05T10:11:12.500000'", "[k] >= '2024-01-05T10:11:12.500000'"]
    assert jdbc.range_predicates('"k"', [dt.date(2024, 1, 5)], False, "oracle") == ["\"k\" < DATE '2024-01-05'", "\"k\" >= DATE '2024-01-05'"]
    assert jdbc.range_predicates("k", [1, 5], False) == ["k < 1", "k >= 1 AND k < 5", "k >= 5"]
