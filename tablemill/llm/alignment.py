"""How two tokenizers cut the same texts: groups of tokens between common borders, and how often two tokens end together.

Every text is encoded twice. Tokens of side A and side B that end at the same byte are linked, and cut the tokens into groups. For each link it
matters how often its pair of ids is linked in the whole corpus, and whether no other A id is linked with its B id more often.

Counting is external. Tasks go through blocks of documents and write records (pair, document, times) as runs: one run per radix of the B id
and block, ordered by B id and then A id, compressed by zstd. Runs are rows of a written table in the shared folder, so memory stays bounded
and a lost executor costs its own blocks. For the totals each run is reduced to its pairs and times, and the reduced runs of a
radix go through k-way heap merges, a bounded number at a time, until one is left: its order brings all pairs of a B id one after the
other, which gives the largest count of each B id on the way. Then the runs meet the totals of their radix, cut into slices of bounded size
where a B id is frequent, and what each link contributes flows back to the documents of the block as sums.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage

#: Parts of the B ids, records of a block and of a slice of a radix, and runs that one merge takes.
RADIXES, BLOCK_RECORDS, SLICE_RECORDS, FAN_IN = 64, 1 << 20, 1 << 23, 256

#: Documents of a block at most, whatever they hold.
BLOCK_DOCS = 8192

MARK = "▁"

# Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Side:
    """A tokenizer: ids of a list of texts, and the bytes of each id. ``prefixed`` tells that it puts a space in front by itself."""

    encode: Callable[[Sequence[str]], list[list[int]]]
    values: tuple[bytes, ...]
    prefixed: bool


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_side(path: str) -> Side:
    """Byte-level BPE from a tokenizer's JSON file. Strings of special tokens are plain text. The ids are the merge ranks, so any byte-level
    merger over the same ranks and splits gives the file's encoding."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    letters, special = _byte_letters(), {t["id"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in text): n for text, n in model["model"]["vocab"].items() if n not in special}
    values = [b""] * (max(ranks.values()) + 1)
    for value, n in ranks.items():
        values[n] = value
    own = tiktoken.Encoding("side", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [own.encode_ordinary(t) for t in texts], tuple(values), False)


@lru_cache(maxsize=4)
def piece_side(path: str) -> Side:
    """A SentencePiece model file. Its marks stand for spaces, byte pieces for their byte."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    values = tuple(bytes([int(own.id_to_piece(n)[1:-1], 16)]) if own.is_byte(n) else own.id_to_piece(n).replace(MARK, " ").encode() for n in range(own.get_piece_size()))
    return Side(lambda texts: own.encode(list(texts), num_threads=1), values, True)


class Pair:
    """Two sides with lookup tables for lengths and decimal forms."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.widths = [np.array([len(v) for v in side.values], dtype=np.int64) for side in (a, b)]
        # a token's decimal form before another of its group, before the other side, and before the next group
        self.forms = [f"{n}{after}" for side in (a, b) for n in range(len(side.values)) for after in ",|;"]
        self.shift = 3 * len(a.values)
        self.radix = len(a.values)

    def align(self, text: str, ids_a: Sequence[int], ids_b: Sequence[int]) -> tuple[np.ndarray, int, str] | None:
        """(pairs of all links, groups, groups as text), or None where the sides don't spell the text. A pair is b * vocabulary of A + a."""
        wanted = (" " + text).encode()
        if b"".join(map(self.a.values.__getitem__, ids_a)) != wanted or b"".join(map(self.b.values.__getitem__, ids_b)) != wanted:
            return None
        a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
        end_a, end_b = self.widths[0][a].cumsum(), self.widths[1][b].cumsum()
        mark = np.zeros(len(wanted) + 1, dtype=np.int8)
        mark[end_a] = 1
        mark[end_b] += 2
        last_a, last_b = np.flatnonzero(mark[end_a] == 3), np.flatnonzero(mark[end_b] == 3)
        return b[last_b] * self.radix + a[last_a], len(last_a), self._groups(a, b, last_a, last_b)

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: A's and B's ids of each group in order."""
        form_a, form_b = 3 * a, 3 * b + self.shift
        form_a[last_a] += 1
        form_b[last_b] += 2
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        before_b, through_a = sizes_b.cumsum() - sizes_b, sizes_a.cumsum()
        every = np.empty(len(a) + len(b), dtype=np.int64)
        every[np.arange(len(a)) + np.repeat(before_b, sizes_a)] = form_a
        every[np.arange(len(b)) + np.repeat(through_a, sizes_b)] = form_b
        return "".join(map(self.forms.__getitem__, every.tolist()))[:-1]


def _packed(*columns: np.ndarray) -> bytes:
    """A run: columns of 64-bit integers, the first one rising and kept as differences, compressed."""
    first = np.diff(columns[0], prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.array([len(first)]), first, *columns[1:]]).astype("<i8").tobytes())


def _unpacked(run: bytes, columns: int) -> list[np.ndarray]:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(run), dtype="<i8")
    size = int(values[0])
    parts = [values[1 + n * size : 1 + (n + 1) * size] for n in range(columns)]
    return [parts[0].cumsum(), *parts[1:]]


_KEPT = "block bigint, at int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, radix int, records bigint, run binary"


def _spill(docs: DataFrame, path_a: str, path_b: str, radixes: int, block_records: int) -> DataFrame:
    """Encoded documents, written: a row per document (radix null), and a row per run (id null) of (pair, place in the block, times)."""
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(byte_side(path_a), piece_side(path_b))
        block, docs_in, records = TaskContext.get().partitionId() << 33, 0, []
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                coded = zip(texts, both.a.encode([" " + t for t in texts]), both.b.encode(texts), strict=True)
                rows = []
                for text, ids_a, ids_b in coded:
                    found = both.align(text, ids_a, ids_b) if text else None
                    rows.append((docs_in + len(rows), 0, 0, 0, 0, "") if found is None else
                                (docs_in + len(rows), len(ids_a), len(ids_b), found[1], len(found[0]), hashlib.sha256(found[2].encode()).hexdigest()))
                    if found is not None:
                        pairs, times = np.unique(found[0], return_counts=True)
                        records.append((pairs, np.full(len(pairs), rows[-1][0]), times))
                yield _document_rows(batch.column(0), block, rows)
                docs_in += len(rows)
                if docs_in >= BLOCK_DOCS or sum(len(r[0]) for r in records) >= block_records:
                    yield from _run_rows(batch.column(0).type, block, records, both.radix, radixes)
                    block, docs_in, records = block + 1, 0, []
        if records:
            yield from _run_rows(whole.column(0).type, block, records, both.radix, radixes)

    spilled = docs.mapInArrow(encode, f"id {kind}, {_KEPT}")
    return stage(spilled.withColumn("kind", F.when(F.col("radix").isNull(), "document").otherwise("run")), "spilled", ["kind"])


_ARROW = [pa.field("block", pa.int64()), pa.field("at", pa.int32()), *[pa.field(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
          pa.field("groups_sha256", pa.string()), pa.field("radix", pa.int32()), pa.field("records", pa.int64()), pa.field("run", pa.binary())]


def _document_rows(ids: pa.Array, block: int, rows: list[tuple]) -> pa.RecordBatch:
    size = len(rows)
    columns = [[block] * size, *zip(*rows, strict=True), *[[None] * size] * 3]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]], ["id", *[f.name for f in _ARROW]])


def _run_rows(id_type: pa.DataType, block: int, records: list[tuple], vocabulary: int, radixes: int) -> Iterator[pa.RecordBatch]:
    """The block's records by radix of the B id, each part ordered by pair and document."""
    if not records:
        return
    pairs, places, times = (np.concatenate(c) for c in zip(*records, strict=True))
    radix = pairs // vocabulary % radixes
    order = np.lexsort((places, pairs, radix))
    pairs, places, times, radix = pairs[order], places[order], times[order], radix[order]
    borders = np.searchsorted(radix, np.arange(radixes + 1))
    for n in range(radixes):
        low, high = int(borders[n]), int(borders[n + 1])
        if low < high:
            row = [[block], *[[None]] * 6, [n], [high - low], [_packed(pairs[low:high], places[low:high], times[low:high])]]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *[pa.array(c, f.type) for c, f in zip(row, _ARROW, strict=True)]], ["id", *[f.name for f in _ARROW]])


def _entries(run: bytes) -> Iterator[tuple[int, int]]:
    pairs, times = _unpacked(run, 2)
    return zip(pairs.tolist(), times.tolist(), strict=True)


def merge_runs(runs: Sequence[bytes]) -> bytes:
    """One run (pair, times) from several: a k-way heap merge that adds up the times of equal pairs."""
    pairs, totals = [], []
    for pair, same in groupby(heapq.merge(*map(_entries, runs)), key=lambda entry: entry[0]):
        pairs.append(pair)
        totals.append(sum(times for _, times in same))
    return _packed(np.array(pairs, dtype=np.int64), np.array(totals, dtype=np.int64))


def with_best(run: bytes, vocabulary: int) -> bytes:
    """A merged run with, for each pair, whether no other pair of its B id has a larger total."""
    pairs, totals = _unpacked(run, 2)
    first = np.flatnonzero(np.diff(pairs // vocabulary, prepend=-1))
    largest = np.repeat(np.maximum.reduceat(totals, first), np.diff(first, append=len(pairs)))
    return _packed(pairs, totals, (totals == largest).astype(np.int64))


def _totals(runs: DataFrame, vocabulary: int, fan_in: int) -> DataFrame:
    """(radix, run), one row per radix: pairs with totals and whether they are their B id's most frequent."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = []
            for run in batch.column(2).to_pylist():
                pairs, _, times = _unpacked(run, 3)
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                reduced.append(_packed(pairs[first], np.add.reduceat(times, first)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reduced, pa.binary())], ["radix", "part", "run"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"radix": table["radix"].slice(0, 1), "part": table["part"].slice(0, 1), "run": pa.array([merge_runs(table["run"].to_pylist())], pa.binary())})

    schema = "radix int, part bigint, run binary"
    # blocks of a radix are numbered so that every merge takes fan_in runs and no more
    counted = runs.select("radix", "block").groupBy("radix").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    numbered = counted.select("radix", F.posexplode("blocks").alias("part", "block"))
    left = stage(runs.join(numbered, ["radix", "block"]).select("radix", F.col("part").cast("bigint"), "run").mapInArrow(reduce, schema), "reduced")
    while (left.agg(F.max("part")).first()[0] or 0) > 0:
        left = stage(left.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("radix", "part").applyInArrow(merge, schema), "merged")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([with_best(run, vocabulary) for run in batch.column(2).to_pylist()], pa.binary())], ["radix", "run"])

    return stage(left.mapInArrow(best, "radix int, run binary"), "totals")


def _contributions(runs: DataFrame, totals: DataFrame, slice_records: int) -> DataFrame:
    """(block, at, count_sum, n_best) for the documents that have links."""
    def flow(table: pa.Table) -> pa.Table:
        blocks, sums = [], []
        pairs = totals_of = best = None
        for block, run in sorted(zip(table["block"].to_pylist(), table["run"].to_pylist(), strict=True), key=lambda row: -1 if row[0] is None else row[0]):
            if block is None:
                pairs, totals_of, best = _unpacked(run, 3)
                continue
            mine, places, times = _unpacked(run, 3)
            found = np.searchsorted(pairs, mine)
            order = np.argsort(places, kind="stable")
            places, first = np.unique(places[order], return_index=True)
            blocks.append(block)
            sums.append(_packed(places, np.add.reduceat((totals_of[found] * times)[order], first), np.add.reduceat((best[found] * times)[order], first)))
        return pa.table({"block": pa.array(blocks, pa.int64()), "sums": pa.array(sums, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        parts = [np.concatenate(c) for c in zip(*[_unpacked(s, 3) for s in table["sums"].to_pylist()], strict=True)]
        order = np.argsort(parts[0], kind="stable")
        places, first = np.unique(parts[0][order], return_index=True)
        counts, best = (np.add.reduceat(p[order], first) for p in parts[1:])
        return pa.table({"block": pa.array([table["block"][0].as_py()] * len(places), pa.int64()), "at": pa.array(places, pa.int32()), "count_sum": pa.array(counts, pa.int64()), "n_best": pa.array(best, pa.int64())})

    sizes = runs.groupBy("radix").agg(F.ceil(F.sum("records") / slice_records).cast("int").alias("slices"))  # a row per radix
    cut = runs.join(F.broadcast(sizes), "radix").select("radix", F.pmod(F.xxhash64("block"), "slices").cast("int").alias("slice"), "block", "run")
    spread = totals.join(F.broadcast(sizes), "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("bigint").alias("block"), "run")
    flowed = cut.union(spread).groupBy("radix", "slice").applyInArrow(flow, "block bigint, sums binary")
    return flowed.groupBy("block").applyInArrow(add, "block bigint, at int, count_sum bigint, n_best bigint")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", radixes: int = RADIXES, block_records: int = BLOCK_RECORDS,
          slice_records: int = SLICE_RECORDS, fan_in: int = FAN_IN) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``path_a`` is a byte-level BPE file, which gets a space and the text, ``path_b`` a SentencePiece model, which puts the space in front by
    itself. Null and empty texts, and those that one side does not spell byte by byte, have no tokens: zeros and an empty digest. Repeated rows
    count as often as they are; null and repeated ids stay; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spilled = _spill(rows, path_a, path_b, radixes, block_records)
    runs = spilled.filter("kind = 'run'").select("radix", "block", "records", "run")
    sums = _contributions(runs, _totals(runs, len(byte_side(path_a).values), fan_in), slice_records)
    documents = spilled.filter("kind = 'document'").select("block", "at", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    whole = documents.join(sums, ["block", "at"], "left")
    return whole.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
