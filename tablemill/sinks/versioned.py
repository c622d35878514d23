"""Tables in versions: immutable data files, and commits that name the files that are live.

A commit is one small file that appears by a rename, so a table changes as a whole or not at all: rows that a failed or killed job has
written are named by no commit. Changes touch the files they have to:

- an upsert asks the key index of each file (smallest and largest key, and a Bloom filter) which files may hold an updated key,
  looks into the key columns of those, and rewrites the files that do hold one;
- a delete writes (file, row index) lists, which readers leave out; no data file is rewritten.

Layout of a table's folder: ``commits/<number>.json`` names a file list, ``files/<id>`` holds it (a row per live data file), ``data/<id>`` the
data files, ``keys/<id>`` their Bloom filters and ``deleted/<id>`` lists of deleted rows. Nothing is ever removed by the library.

The store has to refuse renaming onto an existing file, as HDFS does; a local folder is checked before the rename. Of two writers that start
from one version the second fails and can try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.filters import combine, predicate
from tablemill.session import broadcast_if_small, stage
from tablemill.sinks.tables import LOAD_MODES, SinkError, columns_differ, latest_updates

#: Bits of the Bloom filter per key and positions per key. Bitmaps of 32,768 bits are the unit of Spark's bitmap functions.
KEY_BITS, POSITIONS, UNIT = 10, 3, 32_768

#: Updated keys up to which Bloom filters are asked; more keys leave hardly a file untouched, so that only key ranges are compared.
PROBED_KEYS = 10_000


class ConflictError(SinkError):
    """Another writer has committed since this one read the table."""


@dataclass(frozen=True)
class Version:
    """A committed state. ``files`` has a row per live data file: (folder, file, rows, low, high, units, gone), where ``gone`` names the
    lists with deleted rows of the file."""

    spark: SparkSession
    path: str
    number: int
    schema: T.StructType
    keys: tuple[str, ...]
    files: DataFrame


def _new_id() -> str:
    return uuid.uuid4().hex


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path and its path class."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark._jsc.hadoopConfiguration()), paths


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all commits of the table at ``path``, rising; empty where there is no table."""
    store, paths = _store(spark, path)
    folder = paths(f"{path}/commits")
    if not store.exists(folder):
        return []
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith((".", "_")))


def open_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last version, or version ``number``; None where there is no table."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if number is not None and number not in known:
        raise SinkError(f"no version {number} of {path}")
    if not known:
        return None
    number = known[-1] if number is None else number
    text = spark.read.text(f"{path}/commits/{number:020d}.json", wholetext=True).first()[0]
    told = json.loads(text)
    schema = T.StructType.fromJson(told["schema"])
    return Version(spark, path, number, schema, tuple(told["keys"]), spark.read.schema(_files_schema(schema, told["keys"])).parquet(f"{path}/files/{told['files']}"))


def _files_schema(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    key = T.StructType([T.StructField(f"k{n}", schema[k].dataType) for n, k in enumerate(keys)] or [T.StructField("k0", T.BooleanType())])
    return T.StructType([T.StructField("folder", T.StringType()), T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("low", key),
                         T.StructField("high", key), T.StructField("units", T.IntegerType()), T.StructField("gone", T.ArrayType(T.StringType()))])


def _commit(spark: SparkSession, path: str, number: int, schema: T.StructType, keys: Sequence[str], files: DataFrame) -> None:
    """Make ``files`` the live ones. The file list is written first; the rename of the commit file is the moment of change."""
    listed = _new_id()
    files.write.parquet(f"{path}/files/{listed}")
    store, paths = _store(spark, path)
    store.mkdirs(paths(f"{path}/commits"))
    target, draft = paths(f"{path}/commits/{number:020d}.json"), paths(f"{path}/commits/_{_new_id()}.json")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps({"files": listed, "schema": schema.jsonValue(), "keys": list(keys)}).encode()))
    out.close()
    if store.exists(target) or not store.rename(draft, target):
        raise ConflictError(f"version {number} of {path} is already there")


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]) if keys else F.struct(F.lit(None).cast("boolean").alias("k0"))


def _positions(units: Column) -> list[Column]:
    """Places of a key in a Bloom filter of so many units."""
    return [F.pmod(F.xxhash64(F.lit(n), F.col("key")), units.cast("bigint") * UNIT) for n in range(POSITIONS)]


def _add_files(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write rows as new data files with their key index. Returns their rows of the file list."""
    spark, folder = df.sparkSession, _new_id()
    df.write.parquet(f"{path}/data/{folder}")
    written = spark.read.schema(df.schema).parquet(f"{path}/data/{folder}").select(F.col("_metadata.file_name").alias("file"), _key(keys).alias("key"))
    measured = written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    sized = stage(measured.withColumn("units", F.ceil(F.col("rows") * KEY_BITS / UNIT).cast("int")), "files")
    if keys:
        placed = written.join(broadcast_if_small(sized.select("file", "units")), "file").select("file", F.explode(F.array(*_positions(F.col("units")))).alias("at"))
        bitmaps = placed.groupBy("file", F.expr(f"at div {UNIT}").alias("unit")).agg(F.bitmap_construct_agg(F.col("at") % UNIT).alias("bitmap"))
        bitmaps.write.parquet(f"{path}/keys/{folder}")
    return sized.select(F.lit(folder).alias("folder"), "file", "rows", "low", "high", "units", F.array().cast("array<string>").alias("gone"))


def _rows(version: Version, files: DataFrame | None = None, located: bool = False) -> DataFrame:
    """Rows of the live files, or of some of them, without the deleted ones. ``located`` adds ``__file`` and ``__row``."""
    spark, path = version.spark, version.path
    listed = (version.files if files is None else files).select("folder", "file", "gone").collect()  # a row per file, as Spark's own listing holds
    columns = [F.col(f"`{f.name}`") for f in version.schema.fields]
    place = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    shown = [F.col(f"`{f.name}`") for f in version.schema.fields] + ([F.col("__file"), F.col("__row")] if located else [])

    def scan(some: Sequence[Any]) -> DataFrame:
        return spark.read.schema(version.schema).parquet(*[f"{path}/data/{r['folder']}/{r['file']}" for r in some])

    whole, cut = [r for r in listed if not r["gone"]], [r for r in listed if r["gone"]]
    parts = [scan(whole).select(*columns, *(place if located else []))] if whole else []
    if cut:
        gone = spark.read.schema("file string, row bigint").parquet(*sorted({f"{path}/deleted/{g}" for r in cut for g in r["gone"]}))
        gone = gone.select(F.col("file").alias("__file"), F.col("row").alias("__row")).distinct()
        parts.append(scan(cut).select(*columns, *place).join(broadcast_if_small(gone), ["__file", "__row"], "left_anti").select(shown))
    if not parts:
        empty = spark.createDataFrame([], version.schema)
        return empty.select(*columns, *([F.lit("").alias("__file"), F.lit(0).cast("bigint").alias("__row")] if located else []))
    return reduce(DataFrame.union, parts)


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Rows of the table at ``path`` as of its last commit, or of an earlier one."""
    version = open_version(spark, path, number)
    if version is None:
        raise SinkError(f"no table at {path}")
    return _rows(version)


def commit_table(df: DataFrame, path: str, mode: str = "insert", keys: Sequence[str] | None = None) -> int:
    """Write ``df`` by load mode as one commit and return its number.

    ``insert`` creates the table or adds rows, ``replace`` keeps its types and exchanges the rows, ``drop_and_reload`` takes new columns and types as well.
    ``keys`` are indexed for upserts; a table keeps those it was created with unless it is dropped. The rows may come from the table itself.
    """
    if mode not in LOAD_MODES:
        raise SinkError(f"unknown load mode {mode}, use one of {LOAD_MODES}; for upserts see commit_upsert()")
    path, spark = path.rstrip("/"), df.sparkSession
    old = open_version(spark, path)
    number = 1 if old is None else old.number + 1
    if old is None or mode == "drop_and_reload":
        keys = tuple(keys if keys is not None else old.keys if old else ())
        unknown = [k for k in keys if k not in df.columns]
        if unknown:
            raise SinkError(f"no key columns {unknown}")
        _commit(spark, path, number, df.schema, keys, _add_files(df, path, keys))
        return number
    if keys is not None and tuple(keys) != old.keys:
        raise SinkError(f"the table's keys are {old.keys}")
    if columns_differ(df, _rows(old, old.files.limit(0))):
        raise SinkError(f"columns differ: table {old.schema.names}, rows {df.columns}")
    added = _add_files(_aligned(df, old.schema), path, old.keys)
    _commit(spark, path, number, old.schema, old.keys, old.files.union(added) if mode == "insert" else added)
    return number


def _aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def files_with_keys(version: Version, wanted: DataFrame) -> DataFrame:
    """The live files, as rows of the file list, that may hold a key of ``wanted`` (key columns, distinct): none that does is left out."""
    asked = stage(wanted.select(_key(version.keys).alias("key")), "asked")
    ends = asked.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return version.files.limit(0)
    edges = asked.agg(F.min("key").alias("first"), F.max("key").alias("last"))
    near = version.files.crossJoin(F.broadcast(edges)).filter("low <= last and high >= first").drop("first", "last")  # beside one row
    if ends["n"] > PROBED_KEYS:
        return near
    probes = asked.agg(F.collect_list("key").alias("keys"))
    pairs = near.crossJoin(F.broadcast(probes)).select("folder", "file", "low", "high", "units", F.explode(F.filter("keys", lambda k: (k >= F.col("low")) & (k <= F.col("high")))).alias("key"))
    at = stage(pairs.select("folder", "file", "key", F.explode(F.array_distinct(F.array(*_positions(F.col("units"))))).alias("at")), "probes")
    folders = [r["folder"] for r in at.select("folder").distinct().collect()]
    if not folders:
        return version.files.limit(0)
    bitmaps = version.spark.read.schema("file string, unit bigint, bitmap binary").parquet(*[f"{version.path}/keys/{f}" for f in sorted(folders)])
    byte = F.floor((F.col("at") % UNIT) / 8).cast("int")
    held = F.conv(F.hex(F.substring("bitmap", byte + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast((at % {UNIT}) % 8 as int))")) != 0
    hit = at.join(bitmaps, (at["file"] == bitmaps["file"]) & (F.expr(f"at div {UNIT}") == bitmaps["unit"])).filter(held).select(at["file"], "key", "at")
    needed = at.groupBy("file", "key").agg(F.count(F.lit(1)).alias("needed"))
    found = hit.groupBy("file", "key").agg(F.count(F.lit(1)).alias("found"))
    both = needed.join(found, ["file", "key"]).filter("found = needed").select("file").distinct()
    return near.join(broadcast_if_small(stage(both, "candidates")), "file", "left_semi").select(version.files.columns)


def commit_upsert(spark: SparkSession, path: str, updates: DataFrame, order_by: str | None = None) -> int:
    """Upsert by the table's keys as one commit; see ``latest_updates`` for several updates of a key. Files without an updated key stay as
    they are. Returns the number of the commit; without updates nothing is committed and the present number comes back."""
    old = open_version(spark, path)
    if old is None or not old.keys:
        raise SinkError(f"no table with keys at {path}")
    latest = stage(latest_updates(old.schema, updates, old.keys, order_by), "updates")
    if latest.isEmpty():
        return old.number
    wanted = broadcast_if_small(latest.select(*[F.col(f"`{k}`") for k in old.keys]))
    candidates = stage(files_with_keys(old, wanted), "candidates")
    holding = _rows(old, candidates, located=True).join(wanted, list(old.keys), "left_semi").select(F.col("__file").alias("file")).distinct()
    holding = broadcast_if_small(stage(holding, "holding"))
    touched = stage(candidates.join(holding, "file", "left_semi").select(old.files.columns), "touched")
    kept = _rows(old, touched).join(wanted, list(old.keys), "left_anti")
    added = _add_files(_aligned(kept.unionByName(latest), old.schema), old.path, old.keys)
    left = old.files.join(broadcast_if_small(touched.select("file")), "file", "left_anti").select(old.files.columns)
    _commit(spark, old.path, old.number + 1, old.schema, old.keys, left.union(added))
    return old.number + 1


def commit_delete(spark: SparkSession, path: str, where: Any = None, mode: str = "all") -> int:
    """Delete the rows for which the filter holds as one commit: their places are listed, and no data file is rewritten. A row for which the
    filter is unknown stays; no filter deletes everything. Returns the number of the commit, the present one if no row goes."""
    old = open_version(spark, path)
    if old is None:
        raise SinkError(f"no table at {path}")
    if not where:
        _commit(spark, old.path, old.number + 1, old.schema, old.keys, old.files.limit(0))
        return old.number + 1
    rows = _rows(old, located=True)
    test = predicate(where, rows, mode) if isinstance(where, Mapping) else combine(list(where), rows, mode)
    listed = _new_id()
    target = f"{old.path}/deleted/{listed}"
    rows.filter(test).select(F.col("__file").alias("file"), F.col("__row").alias("row")).write.parquet(target)
    changed = stage(spark.read.schema("file string, row bigint").parquet(target).select("file").distinct(), "changed")
    if changed.isEmpty():
        return old.number
    marked = old.files.join(broadcast_if_small(changed.withColumn("__hit", F.lit(True))), "file", "left")
    gone = F.when(F.col("__hit"), F.concat("gone", F.array(F.lit(listed)))).otherwise(F.col("gone")).alias("gone")
    _commit(spark, old.path, old.number + 1, old.schema, old.keys, marked.select(*[F.col(c) if c != "gone" else gone for c in old.files.columns]))
    return old.number + 1
