"""Sources and sinks. Sinks write to the shared work folder and read back what they wrote."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.operators.filters import apply_filter
from tablemill.operators.projection import calculate
from tablemill.session import new_path, stage
from tablemill.sinks import export, tables, versioned
from tablemill.sources import files, footers, jdbc
from tablemill.streaming.copy import copy_new_files
from tablemill.types import to_sink_types


@query("src_repository", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def repository(t: Tables) -> DataFrame:
    return files.read_repository(t.spark, t.path("customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("src_where_limit", "SELECT count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 LIMIT 1000)")
def where_limit(t: Tables) -> DataFrame:
    return jdbc.where_limit(t.orders, "o_orderstatus = 'F' AND o_totalprice > 100000", 1000).agg(F.count(F.lit(1)).alias("n"))


@query("src_key_ranges", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def key_ranges(t: Tables) -> DataFrame:
    """A table read range by range of a key, as ``read_by_keys`` asks a database for it. Each range is a pushed filter."""
    bounds, nulls = jdbc.key_bounds(t.orders, "o_custkey", 5_000, most=16)
    ranges = [t.orders.filter(F.expr(condition)) for condition in jdbc.range_predicates("o_custkey", bounds, nulls)]
    return reduce(DataFrame.unionAll, ranges).select("o_orderkey", "o_custkey", "o_totalprice")


@query("src_csv", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_type END AS p_type,
    CAST(p_size AS VARCHAR) AS p_size FROM part""")
def csv(t: Tables) -> DataFrame:
    path = new_path(t.spark, "csv")
    kind = F.when(F.col("p_type") == "SMALL", F.lit("N/A")).otherwise(F.col("p_type")).alias("p_type")
    t.part.select("p_partkey", "p_name", "p_brand", kind, "p_size").write.csv(path, header=True)
    return files.read_csv(t.spark, path)


@query("src_sample", "SELECT least(count(*), 10) AS n, least(count(*), 10) AS known FROM lineitem")
def sample(t: Tables) -> DataFrame:
    """Which rows a sample has is open; all have to be rows of the source, none twice."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    drawn = stage(jdbc.sample(t.lineitem), "sample")
    known = drawn.select(keys).distinct().join(t.lineitem.select(keys).distinct(), keys, "left_semi")
    return drawn.agg(F.count(F.lit(1)).alias("n")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))


@query("hana_mapping", "SELECT DISTINCT l_returnflag AS SYS_ID, l_linestatus AS MT_ID, l_linenumber AS COBJ_IDENT FROM lineitem")
def hana_mapping(t: Tables) -> DataFrame:
    return jdbc.mapping_rows(t.lineitem.select(F.col("l_returnflag").alias("SYS_ID"), F.col("l_linestatus").alias("MT_ID"), F.col("l_linenumber").alias("COBJ_IDENT")))


@query("hana_projects", """SELECT h.o_orderkey AS ID, l.l_returnflag AS SOURCE, l.l_linenumber AS IDENT, h.o_orderstatus AS DESCR, s.o_orderkey AS SUBPROJECT,
    l.l_linestatus AS COBJ_ALIAS, h.o_orderstatus AS IS_ACTIVE, c.c_name AS REF_CLIENT, h.o_orderpriority AS ACTIVE_PHASE, l.l_shipdate AS CONTENT_DATE,
    l.l_quantity AS CONTENT_TIME, l.l_suppkey AS AUTHOR, l.l_shipdate AS CREATEDATE, l.l_partkey AS OBJ_GUID, s.o_orderkey AS SPRJ_GUID
    FROM customer p JOIN customer c ON p.c_custkey = c.c_custkey AND p.c_mktsegment = 'BUILDING' LEFT JOIN orders s ON p.c_custkey = s.o_custkey
    LEFT JOIN lineitem l ON l.l_orderkey = s.o_orderkey JOIN orders h ON s.o_orderkey = h.o_orderkey WHERE p.c_acctbal >= 0""")
def hana_projects(t: Tables) -> DataFrame:
    """The five-table project join over tables that play its roles."""
    approach = F.when(F.col("c_mktsegment") == "BUILDING", "STAGING").otherwise("DIRECT")
    projects = t.customer.select(F.col("c_custkey").alias("UUID"), approach.alias("APPROACH"), F.when(F.col("c_acctbal") < 0, "X").otherwise("").alias("TO_BE_DELETED"))
    headers = t.customer.select(F.col("c_custkey").alias("GUID"), F.col("c_name").alias("REF_CLIENT"))
    subprojects = t.orders.select(F.col("o_custkey").alias("PROJECT"), F.col("o_orderkey").alias("GUID"), F.col("o_orderkey").alias("IDENT"))
    objects = t.lineitem.select(
        F.col("l_orderkey").alias("SUBPROJECT"), F.col("l_returnflag").alias("SOURCE"), F.col("l_linenumber").alias("IDENT"), F.col("l_linestatus").alias("COBJ_ALIAS"),
        F.col("l_shipdate").alias("CONTENT_DATE"), F.col("l_quantity").alias("CONTENT_TIME"), F.col("l_suppkey").alias("AUTHOR"),
        F.col("l_shipdate").alias("CREATEDATE"), F.col("l_partkey").alias("GUID"))
    mappings = t.orders.select(F.col("o_orderkey").alias("SUBPROJECT"), F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("DESCR"),
                               F.col("o_orderstatus").alias("IS_ACTIVE"), F.col("o_orderpriority").alias("ACTIVE_PHASE"))
    return jdbc.project_objects(projects, headers, subprojects, objects, mappings)


@query("src_batched_copy", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus <> 'P'")
def batched_copy(t: Tables) -> DataFrame:
    """The source read as a stream of files and copied with row-local steps on the way."""
    def step(df: DataFrame) -> DataFrame:
        kept = apply_filter(df, {"column": "o_orderstatus", "operator": "!=", "value": "P"})
        return calculate(kept, [{"name": "doubled", "expression": "o_totalprice * 2"}]).select("o_orderkey", "doubled")

    target, progress = new_path(t.spark, "copy"), new_path(t.spark, "progress")
    copy_new_files(t.spark, t.folder, target, t.orders.schema, progress, step=step, names="orders.parquet")
    return t.spark.read.parquet(target)


@query("row_count", "SELECT count(*) AS row_count FROM orders WHERE o_totalprice > 100000")
def row_count(t: Tables) -> DataFrame:
    return jdbc.row_count(t.orders, "o_totalprice > 100000")


@query("row_count_footers", """SELECT count(*) AS row_count, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey,
    min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber FROM lineitem""")
def footer_counts(t: Tables) -> DataFrame:
    return footers.footer_stats(t.spark, t.path("lineitem"), ["l_orderkey", "l_linenumber"])


def customers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("id"))


CUSTOMERS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"
SUPPLIERS = "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier"


@query("snk_insert", f"{CUSTOMERS} UNION ALL {SUPPLIERS}")
def insert(t: Tables) -> DataFrame:
    path = new_path(t.spark, "insert")
    tables.write_table(customers(t), path)
    tables.write_table(suppliers(t), path)
    return t.spark.read.parquet(path)


@query("snk_replace", SUPPLIERS)
def replace(t: Tables) -> DataFrame:
    path = new_path(t.spark, "replace")
    tables.write_table(customers(t), path)
    tables.write_table(suppliers(t), path, "replace")
    return t.spark.read.parquet(path)


@query("snk_drop_reload", "SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def drop_reload(t: Tables) -> DataFrame:
    path = new_path(t.spark, "reload")
    tables.write_table(customers(t), path)
    tables.write_table(suppliers(t), path, "drop_and_reload")
    return t.spark.read.parquet(path)


@query("snk_schema_mismatch", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def schema_mismatch(t: Tables) -> DataFrame:
    path = new_path(t.spark, "mismatch")
    tables.write_table(customers(t), path)
    tables.write_table(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), path, on_mismatch="recreate")
    return t.spark.read.parquet(path)


@query("snk_upsert", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, arg_max(o_orderstatus, o_orderkey), arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""")
def upsert(t: Tables) -> DataFrame:
    path = new_path(t.spark, "upsert")
    updates = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("version"))
    tables.write_table(tables.upserted(customers(t), updates, ["id"], "version"), path)
    return t.spark.read.parquet(path)


def updates_of(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("version"))


@query("snk_upsert_files", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, arg_max(o_orderstatus, o_orderkey), arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""")
def upsert_files(t: Tables) -> DataFrame:
    """The upsert as two commits over a table of several files, of which each rewrites only the files it has to."""
    path = new_path(t.spark, "versions")
    versioned.commit_table(customers(t).repartitionByRange(16, "id"), path, keys=["id"])
    low = F.col("id") <= 40
    versioned.commit_upsert(t.spark, path, updates_of(t).filter(low), "version")
    versioned.commit_upsert(t.spark, path, updates_of(t).filter(~low), "version")
    return versioned.read_version(t.spark, path)


@query("snk_replace_commit", f"SELECT 'new' AS state, id, name, balance FROM ({SUPPLIERS}) UNION ALL SELECT 'old', id, name, balance FROM ({CUSTOMERS})")
def replace_commit(t: Tables) -> DataFrame:
    """Content before and after a replacement that is one commit."""
    path = new_path(t.spark, "versions")
    first = versioned.commit_table(customers(t), path)
    versioned.commit_table(suppliers(t), path, "replace")
    old = versioned.read_version(t.spark, path, first).select(F.lit("old").alias("state"), "id", "name", "balance")
    return versioned.read_version(t.spark, path).select(F.lit("new").alias("state"), "id", "name", "balance").union(old)


@query("snk_create_types", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ship_day,
    CAST(l_extendedprice AS DOUBLE) AS price, l_returnflag FROM lineitem""")
def create_types(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(15,2)").alias("price")
    return to_sink_types(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("date").alias("ship_day"), price, "l_returnflag"))


@query("snk_business_names", 'SELECT c_custkey AS "Customer", c_name AS "Customer_2", c_acctbal AS "Balance", c_nationkey FROM customer')
def business_names(t: Tables) -> DataFrame:
    labels = {"c_custkey": "Customer", "c_name": "Customer", "c_acctbal": "Balance"}
    return tables.with_business_names(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), labels)


@query("snk_multi", """SELECT 'open' AS sink, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'large', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000""")
def several_sinks(t: Tables) -> DataFrame:
    opened, large = new_path(t.spark, "open"), new_path(t.spark, "large")
    parent = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    tables.write_branches(parent, {opened: lambda df: df.filter("o_orderstatus = 'O'"), large: lambda df: df.filter("o_totalprice > 200000")})
    columns = ["o_orderkey", "o_totalprice"]
    one = t.spark.read.parquet(opened).select(F.lit("open").alias("sink"), *columns)
    return one.unionByName(t.spark.read.parquet(large).select(F.lit("large").alias("sink"), *columns))


def text_customers(t: Tables, broken: bool) -> DataFrame:
    balance = F.col("c_acctbal").cast("string")
    if broken:
        balance = F.when(F.col("c_nationkey") == 3, F.lit("n.v.")).otherwise(balance)
    return t.customer.select((F.col("c_custkey") + 2).alias("row_number"), F.col("c_custkey").cast("string").alias("ID"), F.col("c_name").alias("Name"), balance.alias("Balance"))


@query("snk_append_checked", """SELECT c_custkey + 2 AS row_number, CAST(c_custkey AS VARCHAR) AS first_column_value, 'balance' AS column_name, 'n.v.' AS value
    FROM customer WHERE c_nationkey = 3""")
def append_rejected(t: Tables) -> DataFrame:
    path = new_path(t.spark, "checked")
    tables.write_table(suppliers(t).select("id", "name", "balance"), path)
    return tables.append_checked(text_customers(t, True), path, "row_number")


@query("snk_append_accepted", f"SELECT id, name, balance FROM ({SUPPLIERS} UNION ALL {CUSTOMERS})")
def append_accepted(t: Tables) -> DataFrame:
    path = new_path(t.spark, "checked")
    tables.write_table(suppliers(t).select(F.col("id").cast("bigint").alias("id"), "name", "balance"), path)
    tables.append_checked(text_customers(t, False), path, "row_number")
    return t.spark.read.parquet(path)


@query("snk_upsert_null_order", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, 'new', CAST(min(o_custkey) AS DOUBLE) FROM orders GROUP BY o_custkey""")
def upsert_null_order(t: Tables) -> DataFrame:
    updates = t.orders.select(F.col("o_custkey").alias("id"), F.lit("new").alias("name"), F.col("o_custkey").cast("double").alias("balance"), F.lit(None).cast("bigint").alias("version"))
    return tables.upserted(customers(t), updates, ["id"], "version")


#: Days of a column that is day first: some read both ways, some do not.
DAYS = "CAST(DATE '2024-01-01' + CAST(c_custkey % 366 AS INTEGER) AS {})"


@query("snk_append_dates", f"""SELECT 0 AS id, DATE '2000-01-01' AS day UNION ALL
    SELECT c_custkey, {DAYS.format('DATE')} FROM customer""")
def append_dates(t: Tables) -> DataFrame:
    path = new_path(t.spark, "dates")
    t.spark.sql("SELECT 0L AS id, DATE'2000-01-01' AS day").write.parquet(path)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 366).cast("int"))
    rows = t.customer.select((F.col("c_custkey") + 2).alias("row_number"), F.col("c_custkey").cast("string").alias("id"), F.date_format(day, "dd/MM/yyyy").alias("day"))
    tables.append_checked(rows, path, "row_number")
    return t.spark.read.parquet(path)


@query("snk_append_ids", """SELECT row_number() OVER (ORDER BY s_suppkey) AS __id, s_name AS name, true AS __active FROM supplier UNION ALL
    SELECT (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name, true FROM customer""")
def append_ids(t: Tables) -> DataFrame:
    path = new_path(t.spark, "ids")
    tables.with_system_columns(t.supplier.select("s_suppkey", F.col("s_name").alias("name")), ["s_suppkey"]).drop("s_suppkey").write.parquet(path)
    names = t.customer.select((F.col("c_custkey") + 2).alias("row_number"), F.col("c_name").alias("name"))
    blank = t.customer.select((F.col("c_custkey") + 10**9).alias("row_number"), F.lit(" ").alias("name"))
    again = names.select((F.col("row_number") + 2 * 10**9).alias("row_number"), "name")
    tables.append_checked(names.union(blank).union(again), path, "row_number")
    return t.spark.read.parquet(path)


EXPORT = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'None') AS status, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate,
    CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders WHERE o_totalprice > 50000"""


def export_orders(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return export.export_rows(rows, ["o_orderkey", "status", "o_orderdate", "o_totalprice"], {"column": "o_totalprice", "operator": ">", "value": 50000},
                              [{"column": "o_orderkey"}], "DD/MM/YYYY")


@query("snk_export_csv", EXPORT)
def export_csv(t: Tables) -> DataFrame:
    path = new_path(t.spark, "export")
    export.write_csv(export_orders(t), path)
    return files.read_csv(t.spark, path, missing=())


@query("snk_export_tsv", EXPORT)
def export_tsv(t: Tables) -> DataFrame:
    path = new_path(t.spark, "export")
    export.write_tsv(export_orders(t), path)
    return files.read_csv(t.spark, path, sep="\t", missing=())


@query("snk_export_tsv_escapes", """SELECT CAST(event_id AS VARCHAR) || chr(9) || event_type AS tabbed, replace(props, ',', chr(10)) AS lines, event_type || chr(92) || 'n' AS backslash FROM events""")
def export_tsv_escapes(t: Tables) -> DataFrame:
    path = new_path(t.spark, "export")
    rows = t.events.select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type").alias("tabbed"), F.replace("props", F.lit(","), F.lit("\n")).alias("lines"),
                           F.concat("event_type", F.lit("\\n")).alias("backslash"))
    export.write_tsv(rows, path)
    written = t.spark.read.text(path).filter("value not like 'tabbed%'").select(F.split("value", "\t").alias("v"))
    return written.select(*[export.read_tsv_value(F.col("v")[i]).alias(name) for i, name in enumerate(rows.columns)])


@query("fmt_dates", """SELECT event_id, CASE WHEN date_trunc('second', ts) = date_trunc('day', ts) THEN strftime(ts, '%m-%d-%Y') ELSE strftime(ts, '%m-%d-%Y %H:%M:%S') END AS ts,
    strftime(ts, '%m-%d-%Y') AS day, strftime(ts, '%m-%d-%Y') AS midnight FROM events""")
def format_dates(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", F.col("ts").cast("date").alias("day"), F.date_trunc("DAY", "ts").alias("midnight"))
    return export.format_dates(rows, "MM-DD-YYYY")


@query("norm_export_values", """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS moment,
    strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS readable, to_base64(unhex('FF') || encode(o_orderpriority)) AS opaque FROM orders""")
def plain_values(t: Tables) -> DataFrame:
    readable = F.encode("o_orderpriority", "UTF-8")
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderdate").alias("moment"),
                           F.col("o_orderdate").cast("date").alias("day"), readable.alias("readable"), F.concat(F.unhex(F.lit("FF")), readable).alias("opaque"))
    return export.plain_values(rows)


@query("system_columns", "SELECT row_number() OVER (ORDER BY c_custkey) AS __id, c_custkey, c_name, true AS __active FROM customer")
def system_columns(t: Tables) -> DataFrame:
    return tables.with_system_columns(t.customer.select("c_custkey", "c_name"), ["c_custkey"])


@query("system_columns_dense", "SELECT row_number() OVER (ORDER BY o_orderkey) AS __id, o_orderkey, o_custkey, true AS __active FROM orders")
def system_columns_dense(t: Tables) -> DataFrame:
    """Ids by file and row: the table's files hold the orders by their key."""
    path = new_path(t.spark, "ordered")
    t.orders.select("o_orderkey", "o_custkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return tables.with_dense_ids(t.spark.read.parquet(path))
