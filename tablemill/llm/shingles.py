"""Word shingles, MinHash signatures and exact similarity on shingle sets, as array code for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS = 200_000


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), element by element."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


class Shingler:
    """Sets of hashed word shingles of whole texts.

    A-Z is lower-cased, words are runs of anything but ASCII white space. A set holds the distinct shingles of ``width``
    words; a text of fewer words gives its whole word sequence as one, a text without words (or null) an empty set.
    """

    def __init__(self, width: int = 5):
        self.width = width
        self._multipliers = mix(np.arange(1, width + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
        self._words: dict[bytes, int] = {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        known = self._words
        if len(known) > _CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes of ``text``."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = self._hash(words)
        width = min(self.width, len(words))
        count = len(words) - width + 1
        rolled = np.full(count, np.uint64(width))
        for k in range(width):  # word hashes are random already: a sum of odd multiples tells the positions apart
            rolled += hashes[k : count + k] * self._multipliers[k]
        rolled = mix(rolled)
        rolled.sort()
        return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


class Signer:
    """MinHash signatures of ``values`` components, each kept as its lowest ``bits`` bits."""

    def __init__(self, values: int, bits: int, seed: int = 7):
        state = np.arange(1, 2 * values + 1, dtype=np.uint64) + np.uint64(seed << 32)
        drawn = mix(state * _GOLDEN)
        self.multipliers, self.offsets = drawn[:values] | np.uint64(1), drawn[values:]
        self.values, self.mask = values, np.uint64((1 << bits) - 1)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """One row of ``values`` numbers below 2^bits for a non-empty set."""
        least = np.full(self.values, np.uint64(0xFFFFFFFFFFFFFFFF))
        for start in range(0, len(shingles), 4096):  # bounded blocks, whatever the length of the text
            part = shingles[start : start + 4096]
            least = np.minimum(least, (self.multipliers[:, None] * part[None, :] + self.offsets[:, None]).min(axis=1))
        return mix(least) & self.mask


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted distinct arrays."""
    low, high = sorted((len(one), len(other)))
    if not low or 100 * low < percent * high:
        return False
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (low + high - common)


def as_sets(column: Iterable[bytes]) -> list[np.ndarray]:
    """Shingle sets back from their byte form."""
    return [np.frombuffer(value, dtype=np.uint64) for value in column]


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each row set with each column set, by products of incidence matrices over bounded slices of the shingles."""
    counts = np.zeros((len(rows), len(columns)), dtype=np.int64)
    if not rows or not columns:
        return counts
    of_row, of_column = np.concatenate(rows), np.concatenate(columns)
    shared = np.intersect1d(of_row, of_column)
    at_row, at_column = (np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (rows, columns))

    def entries(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``shared`` and set numbers of the shingles that are shared, in the order of the places."""
        place = np.searchsorted(shared, values)
        known = place < len(shared)
        known[known] = shared[place[known]] == values[known]
        place, at = place[known], at[known]
        order = np.argsort(place, kind="stable")
        return place[order], at[order]

    row_place, row_at = entries(of_row, at_row)
    column_place, column_at = entries(of_column, at_column)
    for start in range(0, len(shared), 2048):
        matrices = []
        for place, at, height in ((row_place, row_at, len(rows)), (column_place, column_at, len(columns))):
            low, high = np.searchsorted(place, [start, start + 2048])
            matrix = np.zeros((height, 2048), dtype=np.float32)
            matrix[at[low:high], place[low:high] - start] = 1
            matrices.append(matrix)
        counts += (matrices[0] @ matrices[1].T).astype(np.int64)
    return counts
