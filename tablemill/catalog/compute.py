"""User code steps."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.catalog import Tables, query
from tablemill.operators import compute


@query("udf_compute_frame", "SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_type <> 'error' GROUP BY user_id")
def frame(t: Tables) -> DataFrame:
    def step(df: DataFrame) -> DataFrame:
        return df.filter("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))

    return compute.compute_frame(t.events, step)


@query("udf_compute_batches", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, value > 10 AS high FROM events")
def batches(t: Tables) -> DataFrame:
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": rows.event_id, "k": rows.props.str.extract(r"(\d+)")[0].astype("int64"), "high": rows.value > 10})

    return compute.compute_batches(t.events.select("event_id", "props", "value"), step, "event_id bigint, k bigint, high boolean")


GROUPED = "SELECT user_id, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY user_id"


@query("udf_compute_grouped", GROUPED)
def grouped(t: Tables) -> DataFrame:
    return _grouped(t)


@query("udf_compute_grouped_hot", GROUPED)
def grouped_hot(t: Tables) -> DataFrame:
    return _grouped(t, max_rows=5)


def _grouped(t: Tables, **options: int) -> DataFrame:
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [rows.user_id.iloc[0]], "n": [len(rows)], "low": [rows.value.min()], "high": [rows.value.max()]})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [parts.user_id.iloc[0]], "n": [parts.n.sum()], "low": [parts.low.min()], "high": [parts.high.max()]})

    schema = "user_id bigint, n bigint, low double, high double"
    return compute.compute_grouped(t.events.select("user_id", "value"), ["user_id"], step, schema, merge, **options)


@query("udf_compute_streamed", GROUPED)
def streamed(t: Tables) -> DataFrame:
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, n, low, high = None, 0, float("inf"), float("-inf")
        for rows in batches:
            user, n, low, high = rows.user_id.iloc[0], n + len(rows), min(low, rows.value.min()), max(high, rows.value.max())
        yield pd.DataFrame({"user_id": [user], "n": [n], "low": [low], "high": [high]})

    return compute.compute_streamed(t.events.select("user_id", "value"), ["user_id"], step, "user_id bigint, n bigint, low double, high double")


@query("udf_output_check", """SELECT * FROM (VALUES ('missing', 'risk'), ('added', 'flag'), ('removed', 'props'), ('all_null', 'flag')) v("check", column_name)
    WHERE (SELECT count(*) FROM events) > 0""")
def output_check(t: Tables) -> DataFrame:
    events = t.events
    return compute.output_check(events, events.drop("props").withColumn("flag", F.lit(None).cast("string")), ["event_id", "risk"])
