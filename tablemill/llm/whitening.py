"""Whitening of vectors by their leading principal components.

A vector's entries become integers, ``floor(scale * entry)``, and each distinct integer vector counts once for the fit. Its covariance is
summed by Spark: sums and counts first, then products of centred entries, added up by matrix row. The driver holds one matrix of the vectors'
dimensions. It is brought to tridiagonal form by Householder reflections, Sturm counts bisect the leading eigenvalues, and inverse
iteration finds their vectors; those whose eigenvalues lie close together are kept orthogonal to each other. Mean and components are
broadcast to project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage

#: Units of an entry, and components that are kept.
SCALE, COMPONENTS = 256.0, 4

#: Eigenvalues nearer to each other than this part of the matrix's norm form a cluster.
CLUSTER = 1e-3

#: Components whose eigenvalue is not above this part of the trace have no direction of their own.
FLAT = 1e-12

_ROWS = 4096
_SMALL = np.finfo(np.float64).eps
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix under Householder reflections."""
    a = np.array(matrix, dtype=np.float64)
    reflectors = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        largest = np.abs(v).max()
        if largest > 0:
            v /= largest
            v[0] += np.copysign(np.sqrt(v @ v), v[0])
            v /= np.sqrt(v @ v)
            p = 2 * (a[k + 1 :, k + 1 :] @ v)
            w = p - (p @ v) * v
            a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
            a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        reflectors.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(len(a) - 1)]), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, bound: float, least: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix below ``bound``. ``least`` stands for pivots that vanish."""
    below, pivot = 0, 1.0
    squares = np.concatenate([[0.0], off * off]).tolist()
    for d, square in zip(diagonal.tolist(), squares, strict=True):
        pivot = d - bound - square / pivot
        if abs(pivot) < least:
            pivot = -least
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> list[float]:
    """The ``count`` largest eigenvalues, falling, each bisected until no number lies between its bounds."""
    size = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    lowest, highest = float((diagonal - reach).min()), float((diagonal + reach).max())
    norm = max(abs(lowest), abs(highest))
    if norm == 0:
        return [0.0] * count
    least = np.finfo(np.float64).tiny + (_SMALL * norm) ** 2
    found = []
    for k in range(1, count + 1):
        low, high = lowest - 2 * _SMALL * norm, highest + 2 * _SMALL * norm
        while low < (middle := (low + high) / 2) < high:
            if count_below(diagonal, off, middle, least) <= size - k:  # the k-th largest is not below
                low = middle
            else:
                high = middle
        found.append(low)
    return found


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchanges; vanishing pivots become ``least``."""
    size = len(diagonal)
    first, second, third = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    lower, x = off.tolist(), right.tolist()
    for i in range(size - 1):
        if abs(lower[i]) > abs(first[i]):
            factor = first[i] / lower[i]
            first[i], first[i + 1], keep = lower[i], second[i] - factor * first[i + 1], first[i + 1]
            second[i], third[i], second[i + 1] = keep, second[i + 1], -factor * second[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(first[i]) < least:
                first[i] = least
            factor = lower[i] / first[i]
            first[i + 1] -= factor * second[i]
            x[i + 1] -= factor * x[i]
    for i in range(size - 1, -1, -1):
        value = x[i] - (second[i] * x[i + 1] if i + 1 < size else 0.0) - (third[i] * x[i + 2] if i + 2 < size else 0.0)
        x[i] = value / (first[i] if abs(first[i]) >= least else least)
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix as rows, by inverse iteration from fixed starts."""
    size = len(diagonal)
    norm = float(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0)) or 1.0
    draw, found = np.random.default_rng(0), np.zeros((len(values), size))
    for k, value in enumerate(values):
        cluster = [j for j in range(k) if abs(values[j] - value) <= CLUSTER * norm]
        x, settled = draw.standard_normal(size), 0
        for _ in range(50):
            for j in [*cluster, *cluster]:
                x = x - (found[j] @ x) * found[j]
            x /= np.sqrt(x @ x)
            if settled >= 2:
                break
            y = _solve_shifted(diagonal, off, value, x, _SMALL * norm)
            largest = np.abs(y).max()
            settled += largest * norm >= 1 / (100 * _SMALL * size)  # grown as much as a solution can
            x = y / largest
        found[k] = x
    return found


def principal_components(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    diagonal, off, reflectors = tridiagonal(covariance)
    values = leading_eigenvalues(diagonal, off, count)
    vectors = eigenvectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ v, v)
    return np.array(values), vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """(id, dims, x) for the rows whose vector has finite entries only: x as bytes of the narrowest integers that hold it.

    An integer beyond 64 bits becomes the nearest one within.
    """
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, cells = [], [], []
            for at, value in enumerate(batch.column(1)):
                entries = value.values if value.is_valid else None
                if entries is None or entries.null_count or not np.isfinite(vector := entries.to_numpy()).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * vector)
                whole = np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
                whole[x >= 2.0**63] = np.iinfo(np.int64).max
                ids.append(at)
                dims.append(len(x))
                cells.append(_narrow(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(dims, pa.int32()), pa.array(cells, pa.binary())], ["id", "dims", "x"])

    return source.mapInArrow(quantise, f"id {source.schema['id'].dataType.simpleString()}, dims int, x binary")


def _narrow(x: np.ndarray) -> bytes:
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return x.astype(next(w for w in _WIDTHS if np.iinfo(w).min <= low and high <= np.iinfo(w).max)).tobytes()


def _wide(cells: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers."""
    widths = {len(c) // dims: np.dtype(w) for c in cells.to_pylist() for w in _WIDTHS if np.dtype(w).itemsize == len(c) // dims}
    result = np.empty((len(cells), dims), dtype=np.int64)
    raw = cells.to_pylist()
    for width, kind in widths.items():
        rows = [n for n, c in enumerate(raw) if len(c) == width * dims]
        result[rows] = np.frombuffer(b"".join(raw[n] for n in rows), dtype=kind).reshape(-1, dims)
    return result


@dataclass(frozen=True)
class Whitening:
    """A fit: count and per-dimension sums of the distinct integer vectors, eigenvalues and components, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def steep(self) -> np.ndarray:
        """Components that have a direction of their own."""
        return self.values > FLAT * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values by component; NaN for a component without spread."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.steep, (x - self.mean) @ self.components.T / np.sqrt(np.where(self.steep, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over dimensions of (n * x - sum)^2."""
        largest = max(int(np.abs(x.astype(object)).max(initial=0)) * self.n + max(map(abs, self.sums), default=0), 1)
        if largest * largest * x.shape[1] < 2**62:
            far = self.n * x - np.array(self.sums, dtype=np.int64)
            return (far * far).sum(axis=1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def _batched(body, dims: int):
    """A mapInArrow function that hands ``body`` bounded blocks of (batch, integer vectors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                yield from body(batch, _wide(batch.column(batch.num_columns - 1), dims))

    return run


def _row_sums(distinct: DataFrame, dims: int, partial, width: int) -> np.ndarray:
    """Sum of matrices over all vectors: ``partial`` gives one of (rows x width) per block, blocks are added inside the task, and Spark adds up
    the tasks' matrices row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                part = partial(_wide(whole.slice(start, _ROWS).column(0), dims))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(c.as_py()) for c in table["cells"]], axis=0)
        return pa.table({"row": table["row"].slice(0, 1), "salt": pa.array([0], pa.int32()), "cells": pa.array([total], pa.list_(pa.float64()))})

    rows = distinct.select("x").mapInArrow(run, "row int, cells array<double>")
    for salts in (64, 1):  # a matrix row of all tasks is first added up in parts
        rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("row", "salt").applyInArrow(add, "row int, salt int, cells array<double>").drop("salt")
    total = np.zeros((0, width))
    for r in sorted(rows.collect(), key=lambda r: r["row"]):
        total = np.vstack([total, r["cells"]])
    return total


def fit(distinct: DataFrame, dims: int, count: int = COMPONENTS) -> Whitening:
    """A fit on the distinct integer vectors (x) of one length. Three jobs: count and sums, centred products, and nothing is collected but them."""
    def added(batch: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        sums = x.sum(axis=0).tolist() if np.abs(x.astype(np.float64)).max(initial=0) < 2**49 else [sum(column) for column in zip(*x.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(s) for s in sums]), pa.array([batch.num_rows] * dims, pa.int64())], ["at", "total", "n"])

    parts = distinct.select("x").mapInArrow(_batched(added, dims), "at int, total string, n bigint")
    sums = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    n, totals = sums[0]["n"], tuple(int(r["total"]) for r in sums)
    mean = np.array([s / n for s in totals])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _row_sums(distinct, dims, products, dims) / n
    covariance = (covariance + covariance.T) / 2
    values, components = principal_components(covariance, min(count, dims))
    return Whitening(n, totals, np.maximum(values, 0.0), components, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, dims: int, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened distinct vectors minus the identity; None without components that have spread."""
    steep = np.flatnonzero(model.steep)
    if not len(steep):
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.project(x)[:, steep]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _row_sums(distinct, dims, moments, len(steep)) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(steep))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """(id_col, component int from 1, n, deviation, whitened, explained, identity_error): one row per usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out. Vectors of one length are fitted together and others apart;
    a vector without entries has no components and so no rows, one with fewer than ``count`` entries as many as entries. A component without
    spread (all vectors equal, or on fewer directions) has a null ``whitened`` and explains 0. Repeated rows come as often as they are, and count
    once for the fit; null ids stay; other columns are not read; an empty table gives an empty result. ``deviation`` is an exact integer and fails
    where 64 bits don't hold it.
    """
    rows = stage(quantised(vectors, id_col, vector_col, scale), "quantised")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    result = None
    for dims in sorted(r["dims"] for r in rows.filter("dims > 0").select("dims").distinct().collect()):
        same = rows.filter(F.col("dims") == dims)
        distinct = stage(same.select("x").distinct(), "distinct")
        model = fit(distinct, dims, count)
        projected = same.select("id", "x").mapInArrow(_batched(_projecting(model, identity_error(distinct, dims, model)), dims), schema)
        result = projected if result is None else result.union(projected)
    if result is None:
        result = rows.select("id").limit(0).selectExpr("id", *[f"cast(null as {field.split()[1]}) as {field.split()[0]}" for field in schema.split(", ")[1:]])
    return result.withColumnRenamed("id", id_col)


def _projecting(model: Whitening, error: float | None):
    explained = np.where(model.steep, model.values / (model.trace or 1.0), 0.0)

    def project(batch: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, found = len(explained), model.project(x).ravel()
        total = len(x) * size
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), size))), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
            pa.array([model.n] * total, pa.int64()), pa.array([d for d in model.deviations(x) for _ in range(size)], pa.int64()),
            pa.array(found, pa.float64(), mask=np.isnan(found)), pa.array(np.tile(explained, len(x)), pa.float64()), pa.array([error] * total, pa.float64())],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project
