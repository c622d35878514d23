import pytest

from tablemill.sources.footers import footer_plan, footer_stats
from tests.conftest import rows


def test_footers_answer_without_a_scan(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "cast(id % 7 as int) as k", "date_add(date'2024-01-01', cast(id % 9 as int)) as day", "'x' as t").repartition(4).write.parquet(path)
    text = plan(footer_plan(spark, path, ["id", "day"]))
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id), MIN(day), MAX(day)]" in text
    found = footer_stats(spark, path, ["id", "k"])
    assert found.columns == ["row_count", "min_id", "max_id", "min_k", "max_k"] and rows(found) == [(1000, 0, 999, 0, 6)]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    with pytest.raises(ValueError):
        footer_stats(spark, path, ["t"])


def test_files_without_bounds_are_scanned(spark, tmp_path):
    some, none = str(tmp_path / "some"), str(tmp_path / "none")
    spark.createDataFrame([(1,), (None,), (3,)], "v int").repartition(3).write.parquet(some)  # one file holds nulls only
    assert rows(footer_stats(spark, some, ["v"])) == [(3, 1, 3)]
    spark.createDataFrame([], "v int").write.parquet(none)
    assert rows(footer_stats(spark, none, ["v"])) == [(0, None, None)]
