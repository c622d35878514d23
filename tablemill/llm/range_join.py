"""Near-duplicate vectors: an exact range join over cells around pivots.

On unit vectors, a cosine of ``least`` or more is a Euclidean distance of ``radius = sqrt(2 - 2 * least)`` or less. Each vector
lives in the cell of its nearest pivot. By the triangle inequality a neighbour of v can only live in cell j if v is
no further than ``radius`` from the border between the two cells, which is
``(d(v, p_j)^2 - d(v, p_i)^2) / (2 d(p_i, p_j)) <= radius`` in Euclidean space (and follows from ``d(v, p_j) - d(v, p_i) <= 2 radius``
in any metric). v is copied to those cells; every pair is then found in exactly one cell, and cells are joined on their own.

Cells are cut into blocks of home rows and blocks of visiting rows, so that a task holds two bounded blocks even where one
cell has a third of all vectors. Links are counted inside the task, which passes on a count per vector and a spanning
forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.components import components
from tablemill.session import stage

LEAST = 0.95

#: Vectors per cell that the number of pivots aims at, and rows of a block of visitors.
CELL_ROWS, VISIT_ROWS = 4096, 16384

#: Vectors from which pivots are chosen: a bound on what the driver sees, whatever the table. Any pivots give exact results.
PIVOT_SAMPLE, MOST_PIVOTS = 2048, 1024

#: Tolerance for rounding when cells are chosen and when single precision picks what double precision decides.
SLACK = 1e-4


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST,
                 cell_rows: int = CELL_ROWS, visit_rows: int = VISIT_ROWS) -> DataFrame:
    """One row per row of ``vectors``: (id_col, n_links long, component_id, kept).

    ``n_links`` counts the other rows with a cosine of ``least`` (0 < least < 1) or more in double precision, ``component_id``
    is the smallest id that links reach, the row's own included, and ``kept`` tells whether that is its own. Vectors that are
    null, empty, zero or have null or non-finite components link with nothing; vectors of different lengths don't link either.
    Equal vectors are one class that is joined once and counted with its size. An empty table gives an empty result; a null
    id is never the smallest; other columns are not read.
    """
    if not 0 < least < 1:
        raise ValueError("least has to lie between 0 and 1")
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    id_type = source.schema["id"].dataType.simpleString()
    whole = source.mapInArrow(_normalise, f"id {id_type}, hash binary, dims int, vector binary")
    rows = stage(whole, "vectors")
    classes = rows.filter("hash is not null").groupBy("hash", "dims").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.min("vector").alias("vector"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = _cell_links(classes, least, cell_rows, visit_rows)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.drop("vector").join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "component").select("hash", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.filter("hash is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    result = rows.filter("hash is not null").select("id", "hash").join(named, "hash").select("id", "n_links", "component_id").union(alone)
    return result.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id",
                         F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, dims, vector as bytes): unit vectors in double precision, null where a vector cannot link."""
    for batch in batches:
        hashes, dims, units = [], [], []
        for value in batch.column(1):
            values = value.as_py()
            vector = np.array(values, dtype=np.float64) if values and None not in values else np.zeros(0)
            largest = np.abs(vector).max(initial=0.0)
            usable = bool(largest > 0 and np.isfinite(vector).all())
            if usable:
                vector = vector / largest  # squares neither overflow nor vanish
                vector = vector / np.sqrt((vector * vector).sum())
            hashes.append(xxhash.xxh3_128_digest(vector) if usable else None)
            dims.append(len(vector) if usable else None)
            units.append(vector.tobytes() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())],
                                         ["id", "hash", "dims", "vector"])


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of the sample, each the one furthest from those before it; fewer where all others are copies."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < count:
        k = int(nearest.argmin())
        if nearest[k] > 1 - SLACK:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, sample @ sample[k])
    return sample[chosen]


def _cell_links(classes: DataFrame, least: float, cell_rows: int, visit_rows: int) -> DataFrame:
    """(node, links, root), staged: per task and vector the rows it links with there, and its component in that task."""
    schema = "node bigint, links bigint, root bigint"
    found = None
    for dims, count in sorted((row["dims"], row["count"]) for row in classes.groupBy("dims").count().collect()):
        same = classes.filter(F.col("dims") == dims)
        picked = same.orderBy(F.xxhash64("hash")).limit(PIVOT_SAMPLE).select("vector").collect()
        sample = np.frombuffer(b"".join(bytes(row["vector"]) for row in picked)).reshape(-1, dims)
        pivots = choose_pivots(sample, min(MOST_PIVOTS, -(-count // cell_rows)))
        placed = stage(same.select("node", "copies", "vector").mapInArrow(_placing(pivots, least, dims),
                                                                          "cell int, home boolean, node bigint, copies bigint, vector binary"), "placed")
        sizes = placed.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("visits"))
        sizes = F.broadcast(sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / cell_rows)).cast("int").alias("home_blocks"),
                                         F.ceil(F.col("visits") / visit_rows).cast("int").alias("visit_blocks")))  # a row per pivot
        spread = placed.join(sizes, "cell")
        salt = F.xxhash64("node")
        homes = spread.filter("home").select("cell", F.pmod(salt, "home_blocks").cast("int").alias("home_block"), F.explode(F.sequence(F.lit(0), F.col("visit_blocks") - 1)).alias("visit_block"),
                                             F.lit(True).alias("fixed"), "home", "node", "copies", "vector")
        visits = spread.select("cell", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("home_block"), F.pmod(salt, "visit_blocks").cast("int").alias("visit_block"),
                               F.lit(False).alias("fixed"), "home", "node", "copies", "vector")
        links = homes.union(visits).groupBy("cell", "home_block", "visit_block").applyInArrow(_joining(least, dims), schema)
        found = links if found is None else found.union(links)
    if found is None:
        return classes.select("node", F.lit(0).cast("bigint").alias("links"), F.col("node").alias("root"))
    return stage(found, "cell-links")


def _placing(pivots: np.ndarray, least: float, dims: int):
    """Home cell and the later cells whose border lies within reach: the pair is found in the later of two cells."""
    radius = np.sqrt(2 - 2 * least) + SLACK
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                vectors = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, dims)
                cosines = vectors @ pivots.T
                home = cosines.argmax(axis=1)
                gap = cosines[np.arange(len(home)), home][:, None] - cosines  # half the difference of squared distances
                reach = gap <= radius * between[home] + SLACK
                reach &= np.arange(len(pivots))[None, :] >= home[:, None]
                row, cell = np.nonzero(reach)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), *taken.columns], ["cell", "home", "node", "copies", "vector"])

    return place


def _joining(least: float, dims: int):
    """Links of a block of home rows with a block of visitors. Two home rows meet where the smaller one is fixed."""
    def join(table: pa.Table) -> pa.Table:
        fixed = np.array(table["fixed"].to_pylist(), dtype=bool)
        home = np.array(table["home"].to_pylist(), dtype=bool)
        nodes, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist())).reshape(-1, dims)
        one, other = np.flatnonzero(fixed), np.flatnonzero(~fixed)
        links = np.zeros(len(nodes), dtype=np.int64)
        parent = np.arange(len(nodes))

        def roots(of: np.ndarray) -> np.ndarray:
            up = parent[of]
            while not np.array_equal(up, further := parent[up]):
                up = further
            parent[of] = up
            return up

        single = vectors.astype(np.float32)
        for start in range(0, len(one), 256):
            rows = one[start : start + 256]
            i, j = np.nonzero(single[rows] @ single[other].T >= least - SLACK)
            i, j = rows[i], other[j]
            first = ~home[j] | (nodes[i] < nodes[j])
            i, j = i[first], j[first]
            near = np.zeros(len(i), dtype=bool)
            for part in range(0, len(i), 65536):
                cut = slice(part, part + 65536)
                near[cut] = np.einsum("nd,nd->n", vectors[i[cut]], vectors[j[cut]]) >= least
            i, j = i[near], j[near]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while len(i):  # hook larger roots to smaller ones until all links are inside one tree
                a, b = roots(i), roots(j)
                low, high = np.minimum(a, b), np.maximum(a, b)
                open_ = low < high
                if not open_.any():
                    break
                i, j = i[open_], j[open_]
                np.minimum.at(parent, high[open_], low[open_])
        seen = np.flatnonzero(links)
        # a home row may be here twice, fixed and visiting: both stand for the same node and components() joins them
        return pa.table({"node": nodes[seen], "links": links[seen], "root": nodes[roots(seen)]})

    return join
