import pytest
from pyspark.sql import functions as F

from tablemill.ingest import cleaning, inference
from tablemill.ingest.moments import DATE_FORMATS, parse, parse_any, with_reading
from tablemill.ingest.upload import upload
from tests.conftest import rows


def kinds(df):
    return {r.column_name: (r.date_format, r.inferred_type) for r in inference.infer_types(df).collect()}


def text(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{n}` string" for n in names))


def test_types(spark):
    df = text(spark, day=["2024-01-05", None, "2024-12-31", "2023-02-28"], us=["12/25/2024", "01/02/2024", "11/30/2023", "06/07/2022"],
              eu=["25/12/2024", "01/02/2024", "30/11/2023", "06/07/2022"], at=["2024-01-05 10:00:00", "2024-01-05 00:00:00", None, None],
              midnight=["2024-01-05 00:00:00", "2024-01-06 00:00:00", None, None], phone_no=["123", "456", "7", None], intl=["+49", "1", "2", None],
              small=["1", "2", "2147483647", None], big=["1", "3000000000", "5", None], whole=["1.0", "2", "3.00", None], part=["1.5", "2", ".5", None],
              signed=["-1", "2", "3", None], none=[None, None, None, None], mixed=["2024-01-05", "x", "y", "z"])
    assert kinds(df) == {
        "day": ("%Y-%m-%d", "DATE"), "us": ("%m/%d/%Y", "DATE"), "eu": ("%d/%m/%Y", "DATE"), "at": ("%Y-%m-%d %H:%M:%S", "TIMESTAMP"),
        "midnight": ("%Y-%m-%d %H:%M:%S", "DATE"), "phone_no": (None, "VARCHAR(20)"), "intl": (None, "VARCHAR(53)"), "small": (None, "INTEGER"),
        "big": (None, "BIGINT"), "whole": (None, "INTEGER"), "part": (None, "REAL"), "signed": (None, "VARCHAR(52)"), "none": (None, "INTEGER"),
        "mixed": (None, "VARCHAR(60)")}


def test_earlier_format_wins_a_tie(spark):
    df = text(spark, d=["01/02/2024", "03/04/2024"])
    assert kinds(df)["d"] == ("%m/%d/%Y", "DATE")


def test_share_has_to_exceed_sixty_percent(spark):
    assert kinds(text(spark, d=["2024-01-01"] * 3 + ["x"] * 2))["d"][0] is None
    assert kinds(text(spark, d=["2024-01-01"] * 7 + ["x"] * 4))["d"][0] == "%Y-%m-%d"


def test_first_rows_by_key(spark):
    df = spark.createDataFrame([(i, "2024-01-01" if i < 10 else "later") for i in range(50)], "n int, d string")
    assert rows(inference.date_formats(df, ["d"], "n", 12)) == [("d", "%Y-%m-%d")]
    assert rows(inference.date_formats(df, ["d"])) == [("d", None)]


def test_inference_is_one_aggregation(spark, plan):
    df = text(spark, a=["1"], b=["2"], c=["3"])
    text_plan = plan(inference.infer_types(df))
    assert text_plan.count("hashpartitioning") <= 2 and "partial_count" in text_plan and "WholeStageCodegen" in text_plan or "AdaptiveSparkPlan" in text_plan


@pytest.mark.parametrize("fmt", DATE_FORMATS)
def test_formats_agree_with_pandas(spark, fmt):
    import pandas as pd

    values = ["2024-01-05", "2024-1-5", "12/25/2024", "25/12/2024", "1/2/2024", "12-25-2024", "25-12-2024", "2024/02/29", "2023/02/29", "20240115", "15.01.2024",
              "2024-01-05 10:11:12", "12/25/2024 1:2:3", "25/12/2024 23:59:59", "12-25-2024 00:00:00", "25-12-2024 24:00:00", "2024-01-05 10:11:12.5",
              "12-25-2024 10:11:12.123456", "25/12/2024 10:11:12.001", "12/25/2024 10:11:12.7", "25-12-2024 10:11:12.9", "x", "", "2024-13-01", "00/10/2024"]
    expected = pd.to_datetime(pd.Series(values), format=fmt, errors="coerce")
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", parse(F.col("v"), fmt).alias("t"))
    found = {r.i: r.t for r in df.collect()}
    assert [found[i] for i in range(len(values))] == [None if pd.isna(e) else e.to_pydatetime() for e in expected]


def test_readings_agree_with_parsing(spark):
    """Scores by counted readings are what parsing every value in every format gives."""
    values = ["2024-01-05", "2024-1-5", "12/25/2024", "25/12/2024", "1/2/2024", "12-25-2024", "25-12-2024", "2024/02/29", "2023/02/29", "20240115", "20241315", "15.01.2024",
              "31.04.2024", "2024-01-05 10:11:12", "12/25/2024 1:2:3", "25/12/2024 23:59:59", "12-25-2024 00:00:00", "25-12-2024 24:00:00", "2024-01-05 10:11:12.5",
              "12-25-2024 10:11:12.123456", "25/12/2024 10:11:12.001", "12/25/2024 10:11:12.7", "25-12-2024 00:00:00.000001", "2/30/2024", "x", "", "2024-13-01", "00/10/2024",
              "2024-01/05", "2024-01-05 ", "20240115 10:00:00"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    counted = with_reading(df, "v").withColumn("n", F.lit(1))
    scores = counted.groupBy("i").agg(inference._readings().alias("readings")).select("i", inference._scores("readings").alias("scores"))
    parsed = df.select("i", *[parse(F.col("v"), f).alias(f"m{k}") for k, f in enumerate(DATE_FORMATS)])
    for row in scores.join(parsed, "i").collect():
        for k, fmt in enumerate(DATE_FORMATS):
            moment = row[f"m{k}"]
            assert row.scores[k].fmt == fmt and row.scores[k].hits == (moment is not None), (values[row.i], fmt)
            assert row.scores[k].timed == (moment is not None and moment.time().isoformat() != "00:00:00"), (values[row.i], fmt)


def test_inference_of_columns_without_values_and_of_ties(spark):
    rows = [("1/2/2024", None, "3", "x", ".5", "7+", "2024-01-05 00:00:00"), ("3/4/2024", None, "4.0", "", "5.", "8", "2024-01-06 00:00:00")]
    df = spark.createDataFrame(rows, "tie string, none string, whole string, word string, part string, plus string, midnight string")
    found = {r.column_name: (r.date_format, r.max_length, r.inferred_type) for r in inference.infer_types(df).collect()}
    assert found == {"tie": ("%m/%d/%Y", 8, "DATE"), "none": (None, None, "INTEGER"), "whole": (None, 3, "INTEGER"), "word": (None, 1, "VARCHAR(51)"),
                     "part": (None, 2, "REAL"), "plus": (None, 2, "VARCHAR(52)"), "midnight": ("%Y-%m-%d %H:%M:%S", 19, "DATE")}


def test_parse_any_takes_the_first_format(spark):
    df = spark.createDataFrame([("03/04/2024",), ("13/04/2024",)], "v string")
    assert [str(r[0]) for r in df.select(parse_any(F.col("v"))).collect()] == ["2024-03-04 00:00:00", "2024-04-13 00:00:00"]


@pytest.mark.parametrize(("value", "whole", "decimal"), [
    ("1.2E+5", "120000", "120000"), ("1.25e1", "12", "12.5"), ("-3E-1", "0", "-0.3"), (" 12 ", "12", "12"), ("HELLO", "HELLO", "HELLO"), ("1E", "1E", "1E"),
    ("-1.5e3", "-1500", "-1500"), ("4.9123456789E+11", "491234567890", "491234567890"), ("0E0", "0", "0"), (None, None, None)])
def test_scientific(spark, value, whole, decimal):
    df = spark.createDataFrame([(value,)], "v string")
    row = df.select(cleaning.plain_number(F.col("v")).alias("w"), cleaning.plain_number(F.col("v"), "numeric(10,2)").alias("d")).first()
    assert (row.w, row.d) == (whole, decimal)


def test_empty_rows(spark):
    df = spark.createDataFrame([(1, " ", None), (2, "\t\n", 5), (3, "x", None)], "n int, a string, b int")
    assert rows(cleaning.drop_empty_rows(df, ["n"])) == [(2, None, 5), (3, "x", None)]


def test_clean(spark):
    df = spark.createDataFrame([(1, "1E2", "31.12.2024"), (2, "100", "31.12.2024"), (3, "", "")], "n int, `My Value` string, `The-Day` string")
    done = cleaning.clean(df, {"empty_rows": True, "keep": ["n"], "scientific": {"My Value": "int"}, "dates": {"The-Day": None}, "distinct": True, "row_number": "n", "names": True})
    assert done.columns == ["n", "my_value", "the_day"]
    assert [(r.n, r.my_value, str(r.the_day)) for r in done.collect()] == [(1, "100", "2024-12-31 00:00:00")]


def test_sink_types(spark):
    df = text(spark, i=["1", "-2"], f=["1.5", "2"], b=["true", "False"], t=["2024-01-01", "2024-01-01T10:00:00"], m=["1", "x"], e=[None, None])
    assert {r.column_name: r.sink_type for r in inference.sink_types(df).collect()} == {
        "i": "BIGINT", "f": "DOUBLE PRECISION", "b": "BOOLEAN", "t": "TIMESTAMP", "m": "TEXT", "e": "TEXT"}


def test_upload(spark):
    df = text(spark, **{"My Day": ["31.12.2024", "01.02.2024", " "], "Amount": ["1.5", "2", ""], "n": ["2", "1", None], "tel-no": ["0123", None, "  "]})
    table = upload(df, order_by=["n"])
    assert table.dtypes == [("__id", "bigint"), ("my_day", "date"), ("amount", "double"), ("n", "int"), ("tel_no", "string"), ("__active", "boolean")]
    assert [(r["__id"], str(r.my_day), r.amount, r.n, r.tel_no) for r in table.orderBy("__id").collect()] == [(1, "2024-02-01", 2.0, 1, None), (2, "2024-12-31", 1.5, 2, "0123")]
