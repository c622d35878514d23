"""Bulk table changes, written to a new path and read back where content changes."""

from pyspark.sql import DataFrame

from tablemill.catalog import Tables, query
from tablemill.operators import table_changes as change
from tablemill.session import new_path, stage
from tablemill.sinks import versioned

DELETED = [{"column": "quality", "operator": "=", "value": 0}, {"column": "lang", "operator": "IN", "value": "en, de"}]


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("tbl_delete_where", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 0 AND lang IN ('en', 'de'), false)")
def delete(t: Tables) -> DataFrame:
    return stage(change.delete_rows(labelled(t), DELETED), "deleted")


@query("tbl_delete_vectors", """SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)
    WHERE NOT coalesce(quality = 0 AND lang IN ('en', 'de'), false) AND NOT coalesce(lang = 'fr', false)""")
def delete_vectors(t: Tables) -> DataFrame:
    """Two deletes from a versioned table: rows are listed as gone, and no data file is rewritten."""
    path = new_path(t.spark, "versions")
    versioned.commit_table(labelled(t).repartition(6), path)
    versioned.commit_delete(t.spark, path, DELETED)
    versioned.commit_delete(t.spark, path, {"column": "lang", "operator": "=", "value": "fr"})
    return versioned.read_version(t.spark, path)


@query("tbl_delete_count", "SELECT count(*) AS deleted FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 0 AND lang IN ('en', 'de')")
def deleted(t: Tables) -> DataFrame:
    return change.deleted_count(labelled(t), DELETED)


@query("tbl_add_column", "SELECT *, CAST(NULL AS VARCHAR) AS note, CAST(1 AS BIGINT) AS version FROM supplier")
def add(t: Tables) -> DataFrame:
    return change.add_column(change.add_column(t.supplier, "note", "TEXT"), "version", "BIGINT", 1)


@query("tbl_drop_column", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def drop(t: Tables) -> DataFrame:
    return change.drop_column(t.supplier, "s_acctbal")


@query("tbl_rename_column", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal AS balance FROM supplier")
def rename(t: Tables) -> DataFrame:
    return change.rename_column(t.supplier, "s_acctbal", "balance")


@query("tbl_retype_column", "SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_acctbal FROM supplier")
def retype(t: Tables) -> DataFrame:
    return change.retype_column(t.supplier, "s_nationkey", "TEXT")


@query("tbl_retype_loss", "SELECT CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1")
def retype_loss(t: Tables) -> DataFrame:
    return change.retype_loss(t.orders, "o_orderpriority", "BIGINT")


@query("tbl_activity_log", """SELECT 'orders' AS table_name, 'ana' AS modified_by, count(*) AS records_count, 'loaded' AS description FROM orders
    UNION ALL SELECT 'supplier', 'ana', count(*), 'column added' FROM supplier""")
def activity_log(t: Tables) -> DataFrame:
    path = new_path(t.spark, "log")
    change.append_log([change.log_entry(t.orders, "orders", "ana", "loaded"), change.log_entry(t.supplier, "supplier", "ana", "column added")], path)
    return t.spark.read.parquet(path).drop("changed_at")
