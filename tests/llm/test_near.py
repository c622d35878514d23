"""Near-duplicates of texts and vectors against brute force."""

import random
import time

import numpy as np
import pytest

from tablemill.llm import hamming_join, range_join
from tablemill.llm.components import components
from tablemill.llm.shingles import Shingler, Signer, shared_counts, similar


def words_of(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n))


def mutate(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 5 else [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)])


def closure(n, linked):
    smallest = list(range(n))
    moved = True
    while moved:
        moved = False
        for i, j in linked:
            low = min(smallest[i], smallest[j])
            moved |= smallest[i] != low or smallest[j] != low
            smallest[i] = smallest[j] = low
    return smallest


def test_near_groups_agree_with_all_pairs(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "One", "one two three", "ÉTÉ", "été"]
    for base in range(12):
        text = words_of(rng, rng.choice((30, 60, 200)))
        texts += [text, text, text.upper(), *[mutate(rng, text, rng.randrange(1, 8)) for _ in range(9)]]
    texts.append(words_of(rng, 30_000))
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0]
    wanted = closure(len(texts), linked)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, key int")
    found = {r["doc_id"]: r for r in hamming_join.near_groups(docs).collect()}
    assert len(found) == len(texts)
    for i in range(len(texts)):
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(sets[i]), wanted[i], wanted[i] == i)


def test_near_groups_edges(spark):
    schema = "doc_id long, text string"
    assert hamming_join.near_groups(spark.createDataFrame([], schema)).collect() == []
    same = "a b c d e f g h"
    rows = hamming_join.near_groups(spark.createDataFrame([(5, same), (5, same), (None, same), (2, None)], schema)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in rows) == [("2", 2, True), ("5", 5, True), ("5", 5, True), ("None", 5, False)]


@pytest.mark.parametrize("ids", ["numbered", "null", "one"])
def test_rows_without_an_id_of_their_own(spark, ids):
    """2,000 rows whose ids are null or all the same: groups and time as with numbered ids, one named row telling each group."""
    rng = random.Random(6)
    texts = []
    for _ in range(200):
        base = words_of(rng, 40)
        texts += [base, base, *[mutate(rng, base, rng.randrange(1, 4)) for _ in range(8)]]
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for n in range(0, 2000, 10) for i in range(n, n + 10) for j in range(n, i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    wanted = closure(2000, linked)
    own = [n if ids == "numbered" or n % 10 == 0 else None if ids == "null" else 1999 for n in range(2000)]
    start = time.time()
    found = hamming_join.near_groups(spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(zip(own, texts, strict=True))], "doc_id long, text string, n int")).collect()
    assert time.time() - start < 60
    least = {}
    for n, w in enumerate(wanted):
        if own[n] is not None:
            least[w] = min(least.get(w, 10**9), own[n])
    expected = sorted((str(own[n]), len(sets[n]), str(least.get(w))) for n, w in enumerate(wanted))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == expected


def test_block_comparison_finds_what_the_leaders_miss(spark):
    rng = random.Random(5)
    base = words_of(rng, 120)
    texts = [mutate(rng, base, 3) for _ in range(150)]  # many pairs below the threshold, chained together by others
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    wanted = closure(len(texts), linked)
    found = hamming_join.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(wanted))


def test_index_reaches_all_pairs_within_the_distance():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (200, hamming_join.VALUES)).astype(np.uint16)
    other = one.copy()
    for row in other:
        row[rng.choice(hamming_join.VALUES, 31, replace=False)] ^= 1
    shared = [set(a) & set(b) for a, b in zip(hamming_join.index_keys(one).tolist(), hamming_join.index_keys(other).tolist(), strict=True)]
    assert all(shared)


def test_set_helpers():
    shingler, signer = Shingler(), Signer(64, 16)
    a, b = shingler.shingles("a b c d e f"), shingler.shingles("A b C d e f")
    assert np.array_equal(a, b) and len(a) == 2 and np.array_equal(signer.sign(a), signer.sign(b))
    assert not similar(a, shingler.shingles(""), 75) and len(shingler.shingles("x y")) == 1
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(12)]
    counts = shared_counts(sets[:5], sets[5:])
    assert counts.tolist() == [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:5]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300), (200, 250), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("cell_rows, visit_rows", [(4096, 16384), (16, 24)])
def test_near_vectors_agree_with_all_pairs(spark, cell_rows, visit_rows):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 16))
    vectors = [*(c + rng.normal(size=16) * s for c in centres for s in (0.05, 0.2, 0.3, 0.3)), *(centres[0] + rng.normal(size=(60, 16)) * 0.1)]
    rows = [v.tolist() for v in vectors] + [vectors[0].tolist()] * 3 + [(vectors[0] * 1e200).tolist(), None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    order = rng.permutation(len(rows)).tolist()
    table = spark.createDataFrame([(i, rows[i], "x") for i in order], "vec_id long, embedding array<double>, node string")

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or None in x or None in y or not np.isfinite([*x, *y]).all() or not any(x) or not any(y):
            return -1.0
        x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    linked = [(i, j) for i in range(len(rows)) for j in range(i) if cosine(rows[i], rows[j]) >= 0.95]
    wanted = closure(len(rows), linked)
    found = range_join.near_vectors(table, cell_rows=cell_rows, visit_rows=visit_rows).collect()
    assert len(found) == len(rows) and len(linked) > 100
    for r in found:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(i in pair for pair in linked), wanted[i], wanted[i] == i)


def test_near_vectors_of_nothing(spark):
    assert range_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    only = range_join.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]
