import pytest
from pyspark.sql import functions as F

from tablemill.quality import profile, rules
from tests.conftest import rows


def test_numeric_profile(spark):
    df = spark.createDataFrame([(0, 1.5), (None, 0.0), (5, None)], "a int, b double")
    assert rows(profile.numeric_profile(df, ["a", "b"])) == [("a", 0.0, 5.0, "0", "5", 3, 1, 1), ("b", 0.0, 1.5, None, None, 3, 1, 1)]
    assert rows(profile.numeric_profile(df.limit(0), ["a"])) == [("a", None, None, None, None, 0, 0, 0)]


def test_code_profiles(spark):
    df = spark.createDataFrame([(" de",), ("DE",), ("USA",), ("xx ",), (None,)], "c string")
    codes = spark.createDataFrame([("DE",), ("usa",)], "code string")
    assert rows(profile.country_profile(df, "c", codes)) == [("invalid", "XX", 1), ("null", None, 1), ("value", "DE", 2), ("value", "USA", 1), ("value", "XX", 1)]
    assert rows(profile.currency_profile(df, "c", codes)) == sorted(
        [("invalid", "xx ", 1), ("null", None, 1), ("value", "DE", 1), ("value", "USA", 1), ("value", "de", 1), ("value", "xx", 1)])
    units = spark.createDataFrame([("KG",), ("m",)], "unit string")
    measured = spark.createDataFrame([("Kg",), ("kg",), (" parsec",)], "u string")
    assert rows(profile.unit_profile(measured, "u", units)) == [("invalid", "parsec", 1), ("value", "Kg", 1), ("value", "kg", 1), ("value", "parsec", 1)]


def test_pair_profiles(spark):
    df = spark.createDataFrame([("DE", "BY"), ("de", "TX"), ("US", "TX"), ("FR", "TX"), (None, "QQ"), ("US", None)], "c string, r string")
    pairs = spark.createDataFrame([("DE", "BY"), ("US", "TX")], "country string, region string")
    found = rows(profile.region_profile(df, "c", "r", pairs))
    assert [f for f in found if f[0] == "mismatch"] == [("mismatch", "de", "TX", 1)]  # FR is not in the reference, so not judged
    assert [f for f in found if f[0] == "invalid"] == [("invalid", None, "QQ", 1)]
    assert ("total", None, None, 6) in found and ("null", None, None, 1) in found
    postal = rows(profile.postal_profile(df, "c", "r", pairs, "country", "region"))
    assert [f for f in postal if f[0] == "mismatch"] == [("mismatch", "FR", "TX", 1), ("mismatch", "de", "TX", 1)]


def test_date_profile(spark):
    df = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("31/12/2023",), (None,), ("soon",), ("soon",)], "d string")
    row = profile.date_profile(df, "d").first()
    assert (row.total_count, row.null_count, row.invalid_date_count) == (6, 1, 3)
    assert (str(row.min_date), str(row.max_date)) == ("2023-12-31 00:00:00", "2024-02-29 00:00:00")
    assert rows(profile.invalid_dates(df, "d")) == [("2024-02-30",), ("soon",)]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "ann@x.org", 30), (2, " ", 200), (3, None, None), (4, "bad@x", 5)], "id int, mail string, age int")


def test_rules(people):
    checks = [{"column": "mail", "rule": "required"}, {"column": "mail", "rule": "email"}, {"column": "age", "rule": "range", "min": 18, "max": 99},
              {"column": "mail", "rule": "min_length", "min": 2}, {"column": "mail", "rule": "max_length", "max": 5}]
    found = {(r.id, r.column_name, r.rule) for r in rules.violations(people, checks, "id").collect()}
    assert found == {(2, "mail", "required"), (3, "mail", "required"), (2, "mail", "email"), (4, "mail", "email"), (2, "age", "range"), (4, "age", "range"),
                     (2, "mail", "min_length"), (1, "mail", "max_length")}
    assert [(r.rule, r.checked, r.failed) for r in rules.summary(people, checks[:3]).collect()] == [("required", 4, 2), ("email", 4, 2), ("range", 4, 2)]
    for bad in ({"column": "age", "rule": "odd"}, {"column": "age", "rule": "range", "min": 1}):
        with pytest.raises(rules.RuleError):
            rules.rule(bad)


def test_violations_need_no_shuffle(people, plan):
    assert "Exchange" not in plan(rules.violations(people, [{"column": "mail", "rule": "required"}], "id"))


@pytest.mark.parametrize(("kind", "good", "bad"), [
    ("integer", ["1", "-3", "123.0", "1e5", " 7 "], ["", "x", "nan", "1e999", "1d"]),
    ("numeric", ["1.5", "-.5", "1e-3", "NaN", "inf"], ["", "1,5", "1.0f"]),
    ("boolean", ["TRUE", "no", "1", "off", "T", "f"], ["", "maybe", "2"]),
    ("date", ["2024-01-31", "01/31/2024", "31/01/2024", "2024/1/5"], ["2024-02-30", "01-31-2024", "20240131"]),
    ("timestamp", ["2024-01-31 10:00:00", "2024-01-31T10:00:00", "2024-01-31 10:00:00.25", "31/01/2024 1:02:03"], ["2024-01-31", "2024-01-31 25:00:00"]),
    ("time", ["10:30", "23:59:59", "1:05 PM", "12:00:00 am"], ["24:00", "13:00 PM", "10"]),
    ("uuid", ["123e4567-e89b-12d3-a456-426614174000", "{123E4567E89B12D3A456426614174000}", "urn:uuid:123e4567-e89b-12d3-a456-426614174000"], ["123", "g23e4567-e89b-12d3-a456-426614174000"]),
    ("jsonb", ['{"a": [1, null]}', "3", '"x"'], ["{", "word", "{'a': 1}"]),
    ("text", ["", "anything"], []),
])
def test_value_types(spark, kind, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad] + [(None, None)], "v string, ok boolean")
    wrong = df.filter(~rules.fits_type(F.col("v"), kind).eqNullSafe(F.col("ok"))).collect()
    assert wrong == []


def test_expressions(people):
    assert rules.check_expression(people, "upper(mail)") == []
    assert rules.check_expression(people, "age + 1", "NUMERIC") == []
    for text, expected in (("agee + 1", None), ("upper(", None), ("substring(mail)", None), ("upper(mail)", "INTEGER"), ("age", "DATE")):
        assert len(rules.check_expression(people, text, expected)) == 1


def test_patterns():
    assert rules.compose_pattern(["[A-Z]", "", "[0-9]*"]) == "^[A-Z][0-9]*.+$"
    assert rules.compose_pattern(["[A-Z]"], "[0-9]$") == "^[A-Z][0-9]$"


def test_expression_problems_as_rows(people):
    column = people.columns[0]
    valid, report = rules.valid_expressions(people, {"ok": (f"`{column}`", None), "cut": ("1 +", None), "away": ("nowhere", None), "kind": ("'a'", "NUMERIC")})
    assert valid.columns == [*people.columns, "ok"] and valid.count() == people.count()
    assert sorted((r.name, r.kind) for r in report.collect()) == [("away", "UNRESOLVED_COLUMN"), ("cut", "PARSE_SYNTAX_ERROR"), ("kind", "TYPE")]
    assert rules.valid_expressions(people, {})[1].count() == 0
