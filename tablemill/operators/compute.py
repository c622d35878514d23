"""User code as a step: a function from an input frame to an output frame.

Frames never change in place, so the input stays what it was. Code that Spark can express gets the DataFrame; row-local
pandas code gets Arrow batches; pandas code per group gets whole groups, or for large groups a partial and a merge step, or
an iterator over the batches of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import GROUP_ROWS, broadcast_if_small, hot_groups, join_null_safe

#: Results of parts that one task merges in the first round.
MERGE_PARTS = 32

#: Rows that small parts are handed to a worker in. A call of the worker for each part costs far more than the part.
BUCKET_ROWS = 10_000

PandasStep = Callable[[pd.DataFrame], pd.DataFrame]


class ComputeError(ValueError):
    """A compute step that breaks its contract."""


def compute_frame(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a DataFrame function; anything but a DataFrame as its result is an error."""
    result = step(df)
    if not isinstance(result, DataFrame):
        raise ComputeError(f"a compute step returns a DataFrame, not {type(result).__name__}")
    return result


def compute_batches(df: DataFrame, step: PandasStep, schema: str | T.StructType) -> DataFrame:
    """Row-local pandas code over Arrow batches: no shuffle, and no batch is larger than the session's batch size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _checked(step(batch))

    return df.mapInPandas(run, schema)


def compute_grouped(df: DataFrame, keys: Sequence[str], step: PandasStep, schema: str | T.StructType,
                    merge: PandasStep | None = None, max_rows: int = GROUP_ROWS) -> DataFrame:
    """Pandas code per group of ``keys``.

    The call says what a step is, never the data. Without ``merge`` it gets whole groups, however large; it is for groups that
    a task can hold. With ``merge`` every group is a set of parts (one, or several of about ``max_rows`` rows): ``step``
    runs on each part and ``merge`` combines results, in rounds, so it takes its own results as well (output columns in, output
    columns out) and should return few rows. Parts below BUCKET_ROWS go to a worker many at a time, and ``step`` and ``merge`` still get
    them one by one. The number of tasks is fixed, because adaptive execution would merge
    them by bytes while pandas code takes its time by groups.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _checked(step(group))

    def run_whole(group: pd.DataFrame) -> pd.DataFrame:
        return _checked(merge(run(group)))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_groups(df, keys, max_rows) if merge is not None else None
    if hot is None:
        return df.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run if merge is None else run_whole, schema)
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    with_round = T.StructType([*shape.fields, T.StructField("__round", T.IntegerType())])

    def run_part(part: pd.DataFrame) -> pd.DataFrame:
        return run(part.drop(columns="__part")).assign(__round=int(part["__part"].iloc[0]) // MERGE_PARTS)

    def combine_round(parts: pd.DataFrame) -> pd.DataFrame:
        return _checked(merge(parts.drop(columns="__round").reset_index(drop=True)))

    def combine(parts: pd.DataFrame) -> pd.DataFrame:
        return _checked(merge(parts))

    parts = F.ceil(F.col("n_rows") / max_rows).cast("int")
    salted = df.withColumn("__row", F.xxhash64(F.monotonically_increasing_id()))  # by row, so that equal rows spread too
    sized = join_null_safe(salted, broadcast_if_small(hot.withColumn("n_rows", parts)), list(keys), "left_outer")
    part = F.pmod(F.col("__row"), F.coalesce(F.col("n_rows"), F.lit(1))).cast("int")
    cut = sized.withColumn("__part", part).drop("__row", "n_rows")
    if max_rows >= BUCKET_ROWS:
        partial = cut.repartition(tasks, *keys, "__part").groupBy(*keys, "__part").applyInPandas(run_part, with_round)
        return partial.groupBy(*keys, "__round").applyInPandas(combine_round, shape).groupBy(*keys).applyInPandas(combine, shape)
    buckets = max(4 * tasks, -(-df.count() // BUCKET_ROWS))
    rounds = cut.withColumn("__round", F.floor(F.col("__part") / MERGE_PARTS).cast("int"))
    partial = _in_buckets(rounds, [*keys, "__part"], run, with_round, tasks, buckets, hidden=("__part", "__round"), kept="__round")
    merged = _in_buckets(partial, [*keys, "__round"], combine, shape, tasks, buckets, hidden=("__round",))
    return _in_buckets(merged, keys, combine, shape, tasks, buckets)


def _in_buckets(df: DataFrame, by: Sequence[str], run: PandasStep, schema: T.StructType, tasks: int, buckets: int, hidden: Sequence[str] = (), kept: str | None = None) -> DataFrame:
    """``run`` on every group of ``by``, with many small groups in one call of the worker. It does not see the ``hidden`` columns; ``kept`` is
    one that is equal within a group and is added to its result.

    Groups are dealt to buckets by a hash, numbered within their bucket, and cut apart in the worker. Nulls of whole numbers and booleans travel
    as a flag, because a null would change the type of the column for all groups of the bucket.
    """
    flagged = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    truths = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    columns, seen = df.columns, [c for c in df.columns if c not in hidden]

    def run_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        order = rows["__group"].to_numpy().argsort(kind="stable")
        rows = rows.iloc[order].reset_index(drop=True)
        numbers, values = rows["__group"].to_numpy(), rows[seen]
        added = None if kept is None else rows[kept].to_numpy()
        nulls = {c: flags for i, c in enumerate(flagged) if c in seen and (flags := rows[f"__null{i}"].to_numpy(dtype=bool)).any()}
        starts = [0, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), len(rows)]
        alike: dict[tuple, list[tuple[int, pd.DataFrame]]] = {}  # results of other types are kept apart, so that none changes another's
        for first, end in zip(starts, starts[1:], strict=False):
            group = values.iloc[first:end].reset_index(drop=True)
            for name, flags in nulls.items():
                if flags[first:end].any():
                    group[name] = group[name].astype(object if name in truths else "float64").mask(flags[first:end], None if name in truths else float("nan"))
            result = run(group)
            alike.setdefault((tuple(result.columns), tuple(result.dtypes)), []).append((first, result))
        for results in alike.values():
            whole = pd.concat([r for _, r in results], ignore_index=True)
            yield whole if added is None else whole.assign(**{kept: added[[at for at, r in results for _ in range(len(r))]]})

    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(buckets)).cast("int")
    filled = [F.coalesce(F.col(f"`{c}`"), F.lit(False) if c in truths else F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in flagged else F.col(f"`{c}`") for c in columns]
    over = Window.partitionBy("__bucket").orderBy(*[F.col(f"`{c}`") for c in by])
    spread = df.withColumn("__bucket", bucket).repartition(tasks, "__bucket").withColumn("__group", F.dense_rank().over(over))
    sent = spread.select(*filled, *[F.col(f"`{c}`").isNull().alias(f"__null{i}") for i, c in enumerate(flagged)], "__bucket", "__group")
    return sent.groupBy("__bucket").applyInPandas(run_bucket, schema)


def compute_streamed(df: DataFrame, keys: Sequence[str], step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                     schema: str | T.StructType) -> DataFrame:
    """Pandas code per group of ``keys`` that reads its group batch by batch and yields results as it goes.

    For groups that a task can't hold and whose results can't be merged: the worker holds one batch (the session's Arrow batch size) and
    what ``step`` keeps. A group is read by one task, so a hot one takes long but fits; a step that ends early leaves the rest of its
    group unread. Batches of a group come in no particular order.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for result in step(batches):
            yield _checked(result)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, schema)


def _checked(result: object) -> pd.DataFrame:
    if not isinstance(result, pd.DataFrame):
        raise ComputeError(f"a compute step returns a pandas DataFrame, not {type(result).__name__}")
    return result


def output_check(before: DataFrame, after: DataFrame, declared: Sequence[str] = ()) -> DataFrame:
    """Findings about a compute result as (check, column_name): missing declared columns, added and removed columns,
    columns that are null in every row, and an empty result. One aggregation over the result."""
    spark = after.sparkSession
    schema = "check string, column_name string"
    facts = [("missing", c) for c in declared if c not in after.columns]
    facts += [("added", c) for c in after.columns if c not in before.columns]
    facts += [("removed", c) for c in before.columns if c not in after.columns]
    counted = after.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in after.columns])
    name_and_check = [F.struct(F.when(F.col("__rows") == 0, F.lit("empty")).alias("check"), F.lit(None).cast("string").alias("column_name"))]
    name_and_check += [F.struct(F.when((F.col("__rows") > 0) & (F.col(f"`{c}`") == 0), F.lit("all_null")).alias("check"),
                                F.lit(c).alias("column_name")) for c in after.columns]
    found = counted.select(F.explode(F.array(*name_and_check)).alias("f")).select("f.*").filter(F.col("check").isNotNull())
    return spark.createDataFrame(facts, schema).unionByName(found) if facts else found
