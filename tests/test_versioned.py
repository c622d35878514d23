"""Versioned tables: commits, files that stay, deleted rows, and jobs that fail on the way."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablemill.operators.table_changes import delete_rows
from tablemill.sinks import tables, versioned
from tests.conftest import rows


def live(spark, path):
    return {r["file"] for r in versioned.open_version(spark, path).files.collect()}


def data_files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


@pytest.mark.parametrize("spread", ["by range", "by hash"])
def test_an_upsert_of_one_key_rewrites_one_file(spark, tmp_path, spread):
    path = str(tmp_path / "t")
    base = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") * 2).cast("string").alias("b"), (F.col("id") % 7).alias("v"))
    parts = base.repartitionByRange(50, "a") if spread == "by range" else base.repartition(50, F.xxhash64("a"))
    versioned.commit_table(parts, path, keys=["a", "b"])
    before, files = live(spark, path), data_files(path)
    assert len(before) == 50
    update = spark.createDataFrame([(777, "1554", 100)], "a long, b string, v int")
    assert versioned.commit_upsert(spark, path, update) == 2
    assert len(before - live(spark, path)) == 1 and data_files(path).items() >= files.items()
    assert rows(versioned.read_version(spark, path)) == rows(tables.upserted(base, update, ["a", "b"]))
    assert rows(versioned.read_version(spark, path, 1)) == rows(base)
    versioned.commit_upsert(spark, path, spark.createDataFrame([(-1, "new", 1)], "a long, b string, v int"))
    assert before & live(spark, path) == before - (before - live(spark, path)) and versioned.read_version(spark, path).count() == 5001


def test_upserts_agree_with_the_plain_one(spark, tmp_path):
    path = str(tmp_path / "t")
    content = spark.sql("select if(id % 10 = 0, null, id) as id, concat('v', id) as v from range(300)")
    versioned.commit_table(content.repartition(9), path, keys=["id"])
    for low, many in ((0, 5), (100, 250), (-50, 20_000), (5, 0)):
        updates = spark.sql(f"select if(id % 11 = 0, null, id) as id, concat('u{low}-', id) as v, id as n from range({low}, {low + many}) where id % 3 = 0")
        updates = updates.union(updates.filter("id % 2 = 0").withColumn("n", F.col("n") + 1).withColumn("v", F.concat("v", F.lit("!"))))
        wanted = tables.upserted(content, updates, ["id"], "n")
        wanted = spark.createDataFrame(wanted.collect(), content.schema)
        versioned.commit_upsert(spark, path, updates, "n")
        assert rows(versioned.read_version(spark, path)) == rows(wanted)
        content = wanted
    assert versioned.versions(spark, path) == [1, 2, 3, 4]
    with pytest.raises(Exception, match="updated twice"):
        versioned.commit_upsert(spark, path, spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string"))


def test_deletes_leave_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    content = spark.sql("select id, if(id % 5 = 0, null, id % 4) as v from range(200)")
    versioned.commit_table(content.repartition(6), path, keys=["id"])
    files = data_files(path)
    for n, where in enumerate(([{"column": "v", "operator": "=", "value": 1}], [{"column": "id", "operator": "<", "value": 50}], [{"column": "id", "operator": "<", "value": 50}])):
        content = delete_rows(content, where)
        assert versioned.commit_delete(spark, path, where) == min(n + 2, 3)
        assert rows(versioned.read_version(spark, path)) == rows(content)
    assert data_files(path) == files
    versioned.commit_upsert(spark, path, spark.createDataFrame([(1, 9), (60, 9)], "id long, v long"))
    wanted = tables.upserted(content, spark.createDataFrame([(1, 9), (60, 9)], "id long, v long"), ["id"])
    assert rows(versioned.read_version(spark, path)) == rows(wanted)
    versioned.commit_delete(spark, path)
    assert versioned.read_version(spark, path).count() == 0 and data_files(path).items() >= files.items()
    versioned.commit_table(content, path)
    assert rows(versioned.read_version(spark, path)) == rows(content)


def test_a_job_that_fails_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    base = spark.range(100).withColumn("v", F.lit("a"))
    versioned.commit_table(base, path, keys=["id"])
    failing = spark.range(100).repartition(4).withColumn("v", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("b")))
    for mode in tables.LOAD_MODES:
        with pytest.raises(Exception, match="broken"):
            versioned.commit_table(failing, path, mode)
    with pytest.raises(Exception, match="broken"):
        versioned.commit_upsert(spark, path, failing)
    commit = versioned._commit

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versioned, "_commit", killed)
    for change in (lambda: versioned.commit_table(base.limit(1), path, "replace"), lambda: versioned.commit_upsert(spark, path, base.limit(3)),
                   lambda: versioned.commit_delete(spark, path, [{"column": "id", "operator": "<", "value": 9}])):
        with pytest.raises(KeyboardInterrupt):
            change()
    assert rows(versioned.read_version(spark, path)) == rows(base) and versioned.versions(spark, path) == [1]
    monkeypatch.setattr(versioned, "_commit", commit)
    assert versioned.commit_table(versioned.read_version(spark, path).filter("id < 3"), path, "replace") == 2
    assert versioned.read_version(spark, path).count() == 3


def test_two_writers_and_wrong_calls(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    base = spark.range(10).withColumn("v", F.lit("a"))
    versioned.commit_table(base, path, keys=["id"])
    old = versioned.open_version(spark, path)
    versioned.commit_table(base, path)
    monkeypatch.setattr(versioned, "open_version", lambda *_: old)
    with pytest.raises(versioned.ConflictError):
        versioned.commit_table(base, path)
    monkeypatch.undo()
    assert versioned.read_version(spark, path).count() == 20
    for wrong in (lambda: versioned.commit_table(base, path, "merge"), lambda: versioned.commit_table(base.drop("v"), path), lambda: versioned.commit_table(base, path, keys=["v"]),
                  lambda: versioned.read_version(spark, str(tmp_path / "none")), lambda: versioned.read_version(spark, path, 9), lambda: versioned.commit_table(base, path + "2", keys=["w"]),
                  lambda: versioned.commit_upsert(spark, str(tmp_path / "none"), base), lambda: versioned.commit_delete(spark, str(tmp_path / "none"))):
        with pytest.raises(tables.SinkError):
            wrong()
    assert versioned.commit_table(base.withColumnRenamed("v", "w"), path, "drop_and_reload") == 3
    assert versioned.read_version(spark, path).columns == ["id", "w"] and versioned.read_version(spark, path, 2).columns == ["id", "v"]
    empty = str(tmp_path / "empty")
    versioned.commit_table(base.limit(0), empty, keys=["id"])
    versioned.commit_upsert(spark, empty, base)
    assert rows(versioned.read_version(spark, empty)) == rows(base)


def test_dense_ids(spark, tmp_path, plan):
    path = str(tmp_path / "files")
    spark.range(1000).select((F.col("id") * 3).alias("key")).repartitionByRange(7, "key").write.parquet(path)
    numbered = tables.with_dense_ids(spark.read.parquet(path))
    assert sorted(r["__id"] for r in numbered.collect()) == list(range(1, 1001)) and numbered.columns == ["__id", "key", "__active"]
    assert all(r["__id"] == r["key"] // 3 + 1 for r in numbered.collect())
    shown = plan(numbered)
    assert "hashpartitioning" not in shown and "rangepartitioning" not in shown and "BroadcastHashJoin" in shown
    with pytest.raises(tables.SinkError):
        tables.with_dense_ids(spark.read.parquet(path).filter("key > 30"))
    with pytest.raises(tables.SinkError):
        tables.with_dense_ids(spark.read.parquet(path).withColumnRenamed("key", "id"))
