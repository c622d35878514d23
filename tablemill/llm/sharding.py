"""Sharding by Karmarkar-Karp differencing: documents of equal text stay together, and the shards' bytes come out nearly equal.

Differencing keeps partial partitions, each a list of subset sums, and repeatedly combines the two of largest spread, the
largest subset of the one with the smallest of the other. No task sees more than a bucket: groups that outweigh a shard's part of a
bucket are placed first (in the same way, where they fill more than a bucket). Then as many buckets as the gaps need are each differenced
together with its share of the partition so far, so that its groups fill the gaps; a few wait for a later round and even out what is
left. Buckets that no gap needs are differenced alone, then by levels: each bucket is a partial partition, and so is what was placed before.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemill.session import stage

#: Partial partitions that one task combines.
BUCKET = 4096

#: Groups of a bucket for each shard, at least.
LEAST_GROUPS = 4

#: Size of the buckets that fill gaps, relative to the gaps, and the share of them that waits for the next round (one in so many).
MARGIN, ROUND = 1.25, 64

#: Rows of a shard that one task numbers.
SLOT_ROWS = 100_000


def difference(partials: Sequence[Sequence[int]]) -> list[list[int]]:
    """For each partial partition (a list of k subset sums) the final subset that each of its subsets goes to.

    Ties in spread go by position. The final subsets are numbered by falling sum. An empty list gives an empty one.
    """
    if not partials:
        return []
    width = len(partials[0])
    sums: list[list[int]] = []
    orders: list[list[int]] = []  # of a leaf: its own subsets by falling sum
    for partial in partials:
        order = sorted(range(width), key=lambda s: -partial[s])
        orders.append(order)
        sums.append([partial[s] for s in order])
    heap = [(sums[n][-1] - sums[n][0], n) for n in range(len(sums))]
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []
    count = itertools.count(len(sums))
    while len(heap) > 1:
        (_, one), (_, other) = heapq.heappop(heap), heapq.heappop(heap)
        added = [a + b for a, b in zip(sums[one], reversed(sums[other]), strict=True)]
        order = sorted(range(width), key=lambda s: -added[s])
        sums.append([added[s] for s in order])
        merged.append((one, other, order))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], next(count)))
    places: list[list[int]] = [[] for _ in sums]
    places[-1] = list(range(width))
    for n in range(len(merged) - 1, -1, -1):
        one, other, order = merged[n]
        above = places[len(partials) + n]
        mine = [0] * width
        for rank, subset in enumerate(order):
            mine[subset] = above[rank]
        places[one], places[other] = mine, mine[::-1]
    result = []
    for n, order in enumerate(orders):
        to = [0] * width
        for rank, subset in enumerate(order):
            to[subset] = places[n][rank]
        result.append(to)
    return result


def assign(groups: DataFrame, shards: int, key_col: str = "key", size_col: str = "size", bucket: int = BUCKET) -> DataFrame:
    """(key_col, shard int) for indivisible ``groups`` with distinct keys and sizes of 0 or more, by differencing.

    Keys must be of a type that can be hashed; sizes must not be null. An empty table gives an empty result. A bucket of fewer groups
    than ``LEAST_GROUPS`` a shard could not fill gaps, so ``bucket`` is at least that.
    """
    if shards < 1 or bucket < 2:
        raise ValueError("at least one shard and two groups to a bucket are needed")
    sized = groups.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{size_col}`").cast("bigint").alias("size"))
    parts, _ = _place(sized, shards, max(bucket, LEAST_GROUPS * shards))
    placed = parts[0] if parts else sized.filter(F.lit(False)).withColumn("subset", F.lit(0))
    for part in parts[1:]:
        placed = placed.union(part)
    return placed.select(F.col("key").alias(key_col), F.col("subset").cast("int").alias("shard"))


def _place(sized: DataFrame, shards: int, bucket: int) -> tuple[list[DataFrame], list[int]]:
    """Parts (key, size, subset) that cover the rows of ``sized`` (key, size), and the subsets' sums."""
    whole = sized.agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total")).first()
    if not whole["count"]:
        return [], [0] * shards
    if whole["count"] <= bucket:
        part, added = _fill(sized.withColumn("leaf", F.lit(0)), [0] * shards, whole["total"])
        return [part], added
    buckets = -(-whole["count"] // bucket)
    # fewer than ``most`` groups are larger than the total divided by it: than a shard's part of a bucket, and than four groups of mean size
    most = max(1, min(shards * buckets, whole["count"] // 4))
    heavy = F.col("size") > whole["total"] // most
    parts, sums = _place(sized.filter(heavy), shards, bucket)
    # equal sizes go by key, so that the outcome does not depend on the order in which rows arrive
    light = sized.filter(~heavy).withColumn("leaf", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    gap, room = shards * max(sums) - sum(sums), whole["total"] - sum(sums)
    filling = min(buckets, int(buckets * gap * MARGIN / room) + 2 if room else buckets) if gap else 0
    for start, end in itertools.pairwise(_round_ends(filling)):
        rows = light.filter((F.col("leaf") >= start) & (F.col("leaf") < end))
        part, added = _fill(rows, [total - min(sums) for total in sums], rows.agg(F.sum("size")).first()[0] or 0)
        parts.append(part)
        sums = [total + more for total, more in zip(sums, added, strict=True)]
    if filling < buckets:
        part, sums = _level(light.filter(F.col("leaf") >= filling), sums, buckets - filling, bucket)
        parts.append(part)
    return parts, sums


def _round_ends(leaves: int) -> list[int]:
    """Where the rounds begin and end among ``leaves``: each leaves some of those it finds for the next one, and the last round is one leaf."""
    ends, left = [0], leaves
    while left > 1:
        left = max(1, left // ROUND)
        ends.append(leaves - left)
    return [*ends, leaves] if leaves else ends


def _fill(rows: DataFrame, ahead: list[int], total: int) -> tuple[DataFrame, list[int]]:
    """(key, size, subset) of ``rows`` (key, size, leaf; of ``total`` size), staged, and what the subsets gain: each leaf is differenced
    together with its share of what the subsets are already ``ahead``, in proportion to its size."""
    shards = len(ahead)
    key_type = rows.schema["key"].dataType.simpleString()

    def fill(leaf: pd.DataFrame) -> pd.DataFrame:
        leaf = leaf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        sizes = leaf["size"].tolist()
        share = [x * sum(sizes) // total for x in ahead] if total else ahead
        own, *others = difference([share, *([size] + [0] * (shards - 1) for size in sizes)])
        subsets = {final: subset for subset, final in enumerate(own)}
        return pd.DataFrame({"key": leaf["key"], "size": sizes, "subset": [subsets[to[0]] for to in others]})

    part = stage(rows.groupBy("leaf").applyInPandas(fill, f"key {key_type}, size bigint, subset int"), "leaves")
    gains = {row["subset"]: row["gain"] for row in part.groupBy("subset").agg(F.sum("size").alias("gain")).collect()}  # a row per shard
    return part, [gains.get(subset, 0) for subset in range(shards)]


def _level(rows: DataFrame, sums: list[int], leaves: int, bucket: int) -> tuple[DataFrame, list[int]]:
    """(key, size, subset) of ``rows`` (key, size, leaf), and the subsets' new sums: each leaf is differenced alone, then their partial
    partitions by levels, ``sums`` being one more of them."""
    shards, least = len(sums), min(sums)
    key_type = rows.schema["key"].dataType.simpleString()

    def first_level(leaf: pd.DataFrame) -> pd.DataFrame:
        leaf = leaf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        sizes = leaf["size"].tolist()
        places = [to[0] for to in difference([[size] + [0] * (shards - 1) for size in sizes])]
        found = [0] * shards
        for size, place in zip(sizes, places, strict=True):
            found[place] += size
        return pd.DataFrame({"key": leaf["key"], "size": sizes, "part": leaf["leaf"], "subset": places, "sums": [found if n == 0 else None for n in range(len(leaf))]})

    def next_level(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        totals = [0] * shards
        found = []
        for part, above, added, to in zip(parts["part"], parts["above"], parts["sums"], difference([list(map(int, added)) for added in parts["sums"]]), strict=True):
            for subset in range(shards):
                totals[to[subset]] += int(added[subset])
                found.append((part, subset, above, to[subset], None))
        found[0] = (*found[0][:4], totals)
        return pd.DataFrame(found, columns=["part", "subset", "above", "to", "sums"])

    placed = stage(rows.groupBy("leaf").applyInPandas(first_level, f"key {key_type}, size bigint, part bigint, subset int, sums array<bigint>"), "leaves")
    result = placed.drop("sums")
    before = rows.sparkSession.createDataFrame([(-1, [total - least for total in sums])], "part bigint, sums array<bigint>")
    level = placed.filter("sums is not null").select("part", "sums").union(before)
    mine, ends, left = -1, list(range(shards)), leaves + 1  # where ``sums`` went
    while left > 1:
        left = -(-left // bucket)
        parts = level.withColumn("above", F.pmod(F.xxhash64("part"), F.lit(left)).cast("bigint"))
        moves = stage(parts.groupBy("above").applyInPandas(next_level, "part bigint, subset int, above bigint, to int, sums array<bigint>"), "level")
        level = moves.filter("sums is not null").select(F.col("above").alias("part"), "sums")
        result = result.join(moves.drop("sums"), ["part", "subset"]).select("key", "size", F.col("above").alias("part"), F.col("to").alias("subset"))
        moved = {row["subset"]: row for row in moves.filter(F.col("part") == mine).collect()}  # a row per shard
        mine, ends = moved[0]["above"], [moved[subset]["to"] for subset in ends]
    totals = level.first()["sums"]
    named = F.array(*[F.lit(ends.index(subset)) for subset in range(shards)])
    return result.select("key", "size", named[F.col("subset")].alias("subset")), [totals[to] + least for to in ends]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Where every document goes: (id_col, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The size is the UTF-8 length of the text plus 1, and ``law`` is ``bytes``: shards come out nearly equal in the sum of sizes, as far
    as the largest group of equal texts allows. Null texts are one group (not that of empty ones) of size 1 a row, with
    a null checksum. ``slot`` numbers a shard's rows from 0 without gaps, in no particular
    order. ``grown_shard`` is null: no law of keys holds. An empty table gives an empty
    result; other columns are not read.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"),
                       F.unhex(F.coalesce(F.sha2(text, 256), F.lit("00"))).alias("key"))
    rows = stage(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    chunks = max(1, -(-rows.count() // slot_rows))
    chunk = F.pmod(F.xxhash64("id", "key", F.monotonically_increasing_id()), F.lit(chunks))  # written, so it stays what it is
    placed = stage(rows.join(assign(stage(groups, "groups"), shards, bucket=bucket), "key").withColumn("chunk", chunk), "placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))  # a row per shard and chunk
    inside = W.partitionBy("shard", "chunk").orderBy("id", "key")
    numbered = placed.withColumn("slot", F.row_number().over(inside) - 1).join(counts, ["shard", "chunk"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                           (F.col("slot") + F.col("ahead")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
