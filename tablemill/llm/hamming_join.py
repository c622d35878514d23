"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's signature is 64 MinHash values of its word shingles, cut to 16 bits each. Two signatures are as far apart as the
number of values in which they differ. The signatures are split into 16 chunks of four values. Of 31 differences, some
chunk has one at most (pigeonhole), so every pair within distance 31 has a chunk that agrees in three of its four values:
the index enumerates, for each chunk, the four ways to leave one value out. Documents of a similarity of 0.75 are further
apart than that once in about 100,000 pairs, more similar ones practically never.

Links are confirmed on the full shingle sets, and the pairs of a bucket are never listed. First every document meets the
smallest member of all its buckets. Buckets whose members are then still in different components chain up to families,
and the sets of a family are compared in blocks inside tasks, which pass on a spanning forest of the links they find. So the
components are those of all links between documents that share a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.components import components
from tablemill.llm.shingles import Shingler, Signer, as_sets, mix, shared_counts, similar
from tablemill.session import broadcast_if_small, stage

VALUES, BITS, CHUNKS = 64, 16, 16
WIDTH, PERCENT = 5, 75

#: Sets of similar size are compared in blocks: sizes grow by this ratio from class to class, and a block holds no more nodes and shingles.
CLASS_RATIO, BLOCK_NODES, BLOCK_SHINGLES = 1.16, 1024, 400_000

#: Rows of a Python batch; texts may be long.
BATCH = 256


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles long, component_id, kept).

    ``component_id`` is the smallest id that links reach, the row's own included; ``kept`` tells whether that is its own id.
    Null, empty and wordless texts have no shingles and link with nothing. Texts of one shingle set (repeated rows among
    them) are one node. A null id is never the smallest. An empty table gives an empty result; other columns are not read.
    """
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    signed = stage(source.mapInArrow(_signing(width), f"id {id_type}, digest bigint, n_shingles bigint, set_hash binary, signature binary"), "signed")
    # the row whose text stands for the class: ids may be null or repeated, so that its digest names it too
    row = F.min(F.struct("digest", F.col("id").isNull().alias("unnamed"), "id"))
    classes = signed.filter("n_shingles > 0").groupBy("set_hash").agg(F.min("id").alias("id"), row.alias("row"), F.min("signature").alias("signature"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = _members(classes)
    sets = _candidate_sets(source, classes, members, width)
    groups = _groups(members, sets, percent)
    smallest = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = smallest.groupBy("component").agg(F.min("id").alias("component_id"))
    named = smallest.join(least, "component").select("set_hash", "component_id")
    empty = signed.filter("n_shingles = 0").withColumn("component_id", F.col("id"))
    linked = signed.filter("n_shingles > 0").join(named, "set_hash")
    result = linked.select("id", "n_shingles", "component_id").union(empty.select("id", "n_shingles", "component_id"))
    return result.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _signing(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer(VALUES, BITS)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                counts, hashes, signatures = [], [], []
                for text in batch.column(2):
                    found = shingler.shingles(text.as_py())
                    counts.append(len(found))
                    hashes.append(xxhash.xxh3_128_digest(found) if len(found) else None)
                    signatures.append(signer.sign(found).astype(np.uint16).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())],
                                                 ["id", "digest", "n_shingles", "set_hash", "signature"])

    return sign


def index_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """One row per signature: for each chunk and each value left out, a key of the other values."""
    size = signatures.shape[1] // chunks
    keys = []
    for chunk in range(chunks):
        for left_out in range(size):
            key = np.full(len(signatures), np.uint64(chunk * size + left_out + 1))
            for k in range(size):
                if k != left_out:
                    key = mix(key) + signatures[:, chunk * size + k].astype(np.uint64)
            keys.append(mix(key))
    return np.stack(keys, axis=1)


def _indexing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
            keys = index_keys(table)
            nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], ["key", "node"])


def _members(classes: DataFrame) -> DataFrame:
    """(key, node, leader) of all buckets with more than one member, staged; leader is the smallest node of the bucket."""
    keys = classes.select("node", "signature").mapInArrow(_indexing, "key bigint, node bigint")
    buckets = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    return stage(keys.join(buckets.filter("leader < last").drop("last"), "key"), "members")


def _candidate_sets(source: DataFrame, classes: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes that share a bucket with another, from their texts."""
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("row", "node", "set_hash")
    wanted = broadcast_if_small(stage(wanted, "wanted"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                nodes, found = [], []
                for node, set_hash, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    shingles = shingler.shingles(text)
                    if xxhash.xxh3_128_digest(shingles) == set_hash:  # digests may meet by chance
                        nodes.append(node)
                        found.append(shingles.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "shingles"])

    texts = source.join(wanted, (F.col("digest") == F.col("row.digest")) & F.col("id").eqNullSafe(F.col("row.id"))).select("node", "set_hash", "text")
    return stage(texts.mapInArrow(shingle, "node bigint, shingles binary").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, staged."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                one, other = as_sets(batch.column(2).to_pylist()), as_sets(batch.column(3).to_pylist())
                linked = pa.array([similar(x, y, percent) for x, y in zip(one, other, strict=True)], pa.bool_())
                yield batch.select([0, 1]).filter(linked)

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return stage(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a bigint, b bigint"), "links")


def _groups(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) over all confirmed links."""
    to_leader = members.filter("node > leader")
    first = to_leader.groupBy(F.col("node").alias("b")).agg(F.min("leader").alias("a"))
    links = _verified(first, sets, percent)
    groups = components(links)
    placed = members.join(groups, "node", "left").select("key", "node", "leader", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    placed = stage(placed.join(mixed, "key", "left_semi").select("node", "leader", "component").distinct(), "placed")
    families = components(placed.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    nodes = placed.select("node", "component").distinct().join(families.withColumnRenamed("component", "family"), "node").join(sets, "node")
    return components(links.union(_block_links(nodes, percent)))


def _block_links(nodes: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links between different components inside each family of ``nodes`` (node, component, family, shingles).

    A family is cut into classes of set size and these into blocks; a task compares two blocks whose sizes can be similar. So a
    family of any size meets in tasks of bounded size, and only the links that join components leave a task.
    """
    reach = math.ceil(math.log(100 / percent) / math.log(CLASS_RATIO))
    size = F.octet_length("shingles") / 8
    nodes = nodes.withColumn("class", F.floor(F.log(size) / math.log(CLASS_RATIO)).cast("int"))
    nodes = stage(nodes, "families")
    width = F.least(F.lit(BLOCK_NODES), F.greatest(F.lit(1), F.floor(BLOCK_SHINGLES / F.pow(F.lit(CLASS_RATIO), F.col("class") + 1))))
    blocks = nodes.groupBy("family", "class").agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias("blocks"))
    own, their = blocks.select("family", "class", F.col("blocks").alias("own")), blocks.select("family", F.col("class").alias("with"), F.col("blocks").alias("their"))
    near = nodes.drop("shingles").withColumn("with", F.explode(F.sequence(F.col("class") - reach, F.col("class") + reach)))
    near = near.join(own, ["family", "class"]).join(their, ["family", "with"])
    near = near.withColumn("mine", F.pmod(F.xxhash64("node"), "own").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("their") - 1)))
    left = (F.col("class") < F.col("with")) | ((F.col("class") == F.col("with")) & (F.col("mine") <= F.col("other")))
    at, across = F.struct("class", "mine"), F.struct(F.col("with").alias("class"), F.col("other").alias("mine"))
    near = near.select("node", "family", F.when(left, at).otherwise(across).alias("low"), F.when(left, across).otherwise(at).alias("high"), left.alias("left"))
    rows = near.join(nodes.select("node", "component", "shingles"), "node")
    return stage(rows.groupBy("family", "low", "high").applyInArrow(_comparing(percent), "a bigint, b bigint"), "block-links")


def _comparing(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        same = table["low"][0] == table["high"][0]
        left = np.array(table["left"].to_pylist(), dtype=bool)
        nodes, groups = table["node"].to_numpy(), table["component"].to_numpy()
        sets = as_sets(table["shingles"].to_pylist())
        sizes = np.array([len(s) for s in sets])
        rows, columns = (np.arange(len(nodes)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        common = shared_counts([sets[i] for i in rows], [sets[j] for j in columns])
        i, j = np.nonzero(100 * common >= percent * (sizes[rows][:, None] + sizes[columns][None, :] - common))
        i, j = rows[i], columns[j]
        apart = groups[i] != groups[j]
        i, j = i[apart], j[apart]
        forest, parent = [], {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        # one link per pair of components is enough
        _, firsts = np.unique(np.stack([np.minimum(groups[i], groups[j]), np.maximum(groups[i], groups[j])]), axis=1, return_index=True)
        for k in firsts:
            one, other = root(groups[i[k]]), root(groups[j[k]])
            if one != other:
                parent[max(one, other)] = min(one, other)
                forest.append((nodes[i[k]], nodes[j[k]]))
        return pa.table({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([x for _, x in forest], pa.int64())})

    return compare
