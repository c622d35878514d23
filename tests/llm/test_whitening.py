"""Whitening against numpy's eigenvectors, and its numerical parts alone."""

import math

import numpy as np
import pytest

from tablemill.llm import whitening

FOLDER = "/root/testdata/sf0.01"


def plain(vectors, count=4):
    """n, sums, covariance, eigenvalues and eigenvectors of the distinct integer vectors."""
    x = np.array(sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors}), dtype=np.int64)
    centred = x - x.sum(axis=0) / len(x)
    covariance = centred.T @ centred / len(x)
    values, columns = np.linalg.eigh(covariance)
    return len(x), x.sum(axis=0), covariance, values[::-1][:count], columns.T[::-1][:count]


def check(found, usable, count=4):
    n, sums, covariance, values, vectors = plain([v for _, v in usable], count)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(found) == len(usable) * min(count, len(sums))
    for identity, v in usable:
        x = np.array([math.floor(256 * float(c)) for c in v], dtype=np.int64)
        for r in by[identity]:
            k = r["component"] - 1
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
            assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-10) and r["identity_error"] < 1e-9
            assert abs(r["whitened"]) == pytest.approx(abs((x - sums / n) @ vectors[k] / math.sqrt(values[k])), rel=1e-6, abs=1e-7)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check(whitening.whiten(rows).collect(), [(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_unusable_repeated_and_odd_rows(spark):
    draw = np.random.default_rng(1)
    usable = [(n, draw.standard_normal(6).tolist()) for n in range(40)]
    rows = [(n, v, "x") for n, v in usable] + [(99, usable[0][1], "x"), (100, None, "x"), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (102, [float("nan")] * 6, "x"), (103, [float("inf")] * 6, "x"), (104, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    check(whitening.whiten(df).collect(), [*usable, (99, usable[0][1])])
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id > 99")).collect() == []
    assert whitening.whiten(df.limit(0)).schema == whitening.whiten(df).schema
    short = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 2.5]), (3, [5.0]), (4, [5.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in short) == [(0, 1, 2), (0, 2, 2), (1, 1, 2), (1, 2, 2), (3, 1, 1), (4, 1, 1)]
    flat = [r for r in short if r["component"] == 2 or r["n"] == 1]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat)
    first = [abs(r["whitened"]) for r in short if r["component"] == 1 and r["n"] == 2]
    assert first == pytest.approx([1.0, 1.0])


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e5, -1e5]), (2, [2e5, 1e5]), (3, [1e5 + 0.004, 7.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(found, rows)
    beyond = spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)int|overflow|large"):
        whitening.whiten(beyond).collect()


@pytest.mark.parametrize("case", ["random", "equal", "clustered", "diagonal", "blocks", "rank one", "one", "two"])
def test_eigenvectors(case):
    draw = np.random.default_rng(2)
    q, _ = np.linalg.qr(draw.standard_normal((60, 60)))
    matrix = {
        "random": lambda: (lambda m: m @ m.T)(draw.standard_normal((60, 60))), "equal": lambda: np.eye(60) * 3.0,
        "clustered": lambda: q @ np.diag([5, 5, 5 - 1e-9, 5 - 1e-5, *np.linspace(1, 4, 56)]) @ q.T, "diagonal": lambda: np.diag(np.arange(60.0)),
        "blocks": lambda: np.kron(np.eye(3), (lambda m: m @ m.T)(draw.standard_normal((20, 20)))), "rank one": lambda: np.outer(q[0], q[0]) * 7,
        "one": lambda: np.array([[2.0]]), "two": lambda: np.array([[2.0, 1.0], [1.0, 2.0]])}[case]()
    matrix = (matrix + matrix.T) / 2
    count = min(4, len(matrix))
    values, vectors = whitening.principal_components(matrix, count)
    assert values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1][:count], rel=1e-12, abs=1e-12)
    assert np.abs(vectors @ vectors.T - np.eye(count)).max() < 1e-12
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() < 1e-11 * max(1.0, values[0])


def test_sturm_count():
    draw = np.random.default_rng(4)
    d, e = draw.standard_normal(30), draw.standard_normal(29)
    e[7] = e[20] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for bound in [-10.0, *(values[:-1] + values[1:]) / 2, 10.0]:
        assert whitening.count_below(d, e, bound, 1e-300) == (values < bound).sum()
