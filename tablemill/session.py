"""Session set-up and the helpers that need the session: shared work folder, staged tables, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A broadcast is only asked for when a side was measured and holds no more than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 256 * 1024 * 1024

# Rows of one group that a single task may be handed before the group is split.
GROUP_ROWS = 2_000_000

# Buckets of the first count for hot groups.
KEY_BUCKETS = 1 << 14


def local_session(app: str = "tablemill", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    settings.setdefault(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="tablemill-"))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as named in ``spark.checkpoint.dir``.

    Only a master inside this process may go without: it gets a fresh temporary folder, which is then set for the session.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tablemill-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that nothing has been written to yet."""
    return f"{work_dir(spark)}/tablemill/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: every later use sees the same rows, and a lost
    executor costs a re-read, not a recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` was counted to have no more than ``rows`` rows and, where columns vary in width, measured to hold no
    more than ``size`` bytes of them. The count comes first and no task counts further than that, so a large side is neither
    read whole nor measured."""
    if df.limit(rows + 1).count() > rows:
        return False
    wide = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not wide:
        return True
    width = F.octet_length(F.to_json(F.struct(*wide)))
    return (df.agg(F.sum(width)).first()[0] or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when the measured size allows it, else ``df`` as it is, which leaves a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int = GROUP_ROWS) -> DataFrame | None:
    """Groups of ``keys`` with more than ``rows`` rows as (keys, n_rows), or None when there are none.

    Rows are counted by a hash of their keys first, into so few buckets that a task passes on a small table whatever the number of
    keys. A group above the limit makes its bucket exceed it too; only the keys of such buckets are counted one by one.
    There are at most total/rows such groups, so the staged result is small.
    """
    named = [F.col(f"`{k}`") for k in keys]
    bucket = F.pmod(F.xxhash64(*named), F.lit(KEY_BUCKETS))
    full = [r["b"] for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows).select("b").collect()]
    if not full:
        return None
    counts = df.filter(bucket.isin(full)).groupBy(*named).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > rows)
    hot = stage(counts, "hot")
    return None if hot.isEmpty() else hot


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal names where nulls match; the right side's copies of the names are dropped."""
    renamed = right.select([F.col(f"`{c}`").alias(f"__on_{c}" if c in on else c) for c in right.columns])
    test = F.lit(True)
    for name in on:
        test = test & F.col(f"`{name}`").eqNullSafe(F.col(f"`__on_{name}`"))
    return left.join(renamed, test, how).drop(*[f"__on_{c}" for c in on])
