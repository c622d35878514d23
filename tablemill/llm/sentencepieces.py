"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a model: a normaliser (white space becomes a visible mark, one mark is put in front), an arc
per piece from its characters to its id, and arcs from any other character to the bytes of its UTF-8 form. A text is
composed with it character by character, and the path of least weight in the tropical semiring is the encoding.

In a unigram model an arc weighs minus the piece's score, and a state is a place in the text. In a BPE model the merges decide and
not a sum of scores: a sequence of pieces is what merging gives exactly if every two neighbours are what merging gives for
their joined text. So the states are (place, last piece), an arc weighs 0 where the two pieces may stand together and infinity
otherwise; one path of finite weight is left, and each place has one finite state.

No piece continues over a white-space mark that follows another character, some characters occur in no longer piece, and some never
stand side by side in one. Every path passes a single state there, so the parts between are composed on their own and remembered by
their text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"

# Fixed values of the model format: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2

#: Arc weight of an unknown character in a unigram model, above that of its dearest piece.
UNKNOWN_EXTRA = 10.0

#: Parts remembered in each of two generations: the older one goes when the younger is full, and parts met again move on.
_REMEMBERED, _LONGEST_REMEMBERED = 600_000, 48

#: Pairs of neighbours whose merging is remembered.
_PAIRS = 1_000_000


class Transducer:
    """A compiled model. ``encode`` and ``decode`` are inverse up to the normaliser."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, dummy_prefix: bool = True, squeeze: bool = False):
        """``pieces`` are (text, score, type) by id; ``squeeze`` drops leading, trailing and repeated spaces."""
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        self.kind, self.dummy_prefix, self.squeeze = kind, dummy_prefix, squeeze
        self.ids = {text: n for n, (text, _, type_) in enumerate(pieces) if type_ in (NORMAL, USER_DEFINED)}
        self.scores = [score for _, score, _ in pieces]
        self.unknown = next((n for n, (_, _, type_) in enumerate(pieces) if type_ == UNKNOWN), 0)
        self.bytes = {int(text[1:-1], 16): n for n, (text, _, type_) in enumerate(pieces) if type_ == BYTE}
        self.values: list[str | int | None] = [int(text[1:-1], 16) if type_ == BYTE else "" if type_ == CONTROL else None if type_ == UNKNOWN else text.replace(MARK, " ") for text, _, type_ in pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.dearest = max((-s for t, s, type_ in pieces if type_ == NORMAL), default=0.0) + UNKNOWN_EXTRA
        self._parts = re.compile(self._part_pattern())
        self._texts = [text for text, _, _ in pieces]
        self._widths = [len(text) for text in self._texts]
        self._characters = {text for text in self.ids if len(text) == 1}
        known = re.escape("".join(sorted(self._characters)))
        self._unknown_parts = re.compile(f"(?s)([{known}]+)|(.)" if known else "(?s)(^(?!))|(.)")
        self._arcs = None
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": {}, "_known": {}, "_older": {}, "_arcs": None}

    def _part_pattern(self) -> str:
        """Parts of a text between places that every path passes in one state: no piece spans them, so nothing is merged over them.

        These are the borders of characters that occur in no longer piece, those before white-space marks, and those between characters that
        no piece has side by side: here a mark or digit (``ends``) after a character that none of them follows in a piece.
        """
        inner = set(chain.from_iterable(text for text in self.ids if len(text) > 1))
        if any(MARK in text.lstrip(MARK) for text in self.ids):
            return "(?s).+"
        beside = {pair for text in self.ids for pair in zip(text, text[1:], strict=False)}
        after_letters = {b for a, b in beside if a.isalpha()}
        ends = {c for c in inner if not c.isalpha() and c != MARK and c not in after_letters}
        before_ends = {a for a, b in beside if b in ends}
        closed = {c for c in inner if c.isalpha() and c not in before_ends}
        listed = lambda characters: re.escape("".join(sorted(characters)))
        alone = listed(chr(c) for c in range(128) if chr(c) not in inner)
        run = f"[^{MARK}{alone}{listed(ends)}]*"
        more = f"(?:(?<![{listed(closed)}])[{listed(ends)}]{run})*" if ends and closed else ""
        return f"[{alone}]|{MARK}*[^{MARK}{alone}]{run}{more}|{MARK}+"

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    def plain(self, text: str) -> str:
        """What decoding gives back for a text."""
        text = text.replace(MARK, " ")
        return re.sub(" +", " ", text.strip(" ")) if self.squeeze else text

    def encode(self, text: str) -> list[int]:
        parts = self._parts.findall(self.normalise(text))
        paths = list(map(self._known.get, parts))
        if None in paths:
            for n, path in enumerate(paths):
                if path is None:
                    paths[n] = self._path(parts[n])
        return list(chain.from_iterable(paths))

    def _path(self, part: str) -> tuple[int, ...]:
        """The path of a part that the younger generation does not hold."""
        path = self._older.get(part)
        if path is None:
            path = self._shortest_path(part)
        if len(part) <= _LONGEST_REMEMBERED:
            if len(self._known) >= _REMEMBERED:
                self._known, self._older = {}, self._known
            self._known[part] = path
        return path

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become replacement characters, ids out of range raise IndexError."""
        values = self.values
        texts, pending = [], bytearray()
        for n in ids:
            value = values[n]
            if type(value) is int:
                pending.append(value)
                continue
            if pending:
                texts.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            texts.append(" ⁇ " if value is None else value)
        texts.append(pending.decode("utf-8", "replace"))
        text = "".join(texts)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def _fallback(self, character: str) -> tuple[int, ...]:
        found = tuple(self.bytes.get(b, -1) for b in character.encode("utf-8", "surrogatepass"))
        return (self.unknown,) if -1 in found else found

    def _shortest_path(self, part: str) -> tuple[int, ...]:
        if self.kind == BPE:
            return tuple(self._bpe_path(part))
        best = self._unigram_arcs(part)
        path: list[tuple[int, ...]] = []
        end = len(part)
        while end:
            start, piece = best[end]
            path.append((piece,) if piece >= 0 else self._fallback(part[start:end]))
            end = start
        return tuple(chain.from_iterable(reversed(path)))

    def _unigram_arcs(self, part: str) -> list[tuple[int, int]]:
        """For each place the arc (start, piece or -1) by which the lightest path gets there; ties go to the earlier start."""
        ids, scores = self.ids, self.scores
        weights = [0.0] + [math.inf] * len(part)
        best = [(0, -1)] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = ids.get(part[start:end], -1)
                if piece < 0 and (start < end - 1 or part[start:end] in ids):
                    continue
                weight = weights[start] + (-scores[piece] if piece >= 0 else self.dearest)
                if weight < weights[end]:
                    weights[end], best[end] = weight, (start, piece)
        return best

    def _bpe_path(self, part: str) -> list[int]:
        """The only path of finite weight. An unknown character has the one arc to its bytes, and nothing merges across it."""
        if self._characters.issuperset(part):
            return self._known_path(part)
        found: list[int] = []
        for known, unknown in self._unknown_parts.findall(part):
            found.extend(self._known_path(known) if known else self._fallback(unknown))
        return found

    def _known_path(self, part: str) -> list[int]:
        """The path through known characters. Arcs come by the place they lead to; what leads to a place with finite weight is what merging
        gives for the text up to there, so a place has one such state and further arcs to it are passed over."""
        if self._arcs is None:
            self._arcs = self._automaton()
        pairs, widths, factor = self._pairs, self._widths, len(self.scores) + 1
        states, starts = [-1, *[-2] * len(part)], [0] * (len(part) + 1)
        for last, piece in self._arcs.iter(part):
            end = last + 1
            if states[end] != -2 or (before := states[start := end - widths[piece]]) == -2:
                continue
            allowed = pairs.get(before * factor + piece)
            if allowed or (allowed is None and self._together(before, piece)):
                states[end], starts[end] = piece, start
        found = []
        place = len(part)
        while place:
            found.append(states[place])
            place = starts[place]
        found.reverse()
        return found

    def _automaton(self):
        """All pieces by their characters: composed with a text it gives every arc."""
        arcs = ahocorasick.Automaton()
        for text, n in self.ids.items():
            arcs.add_word(text, n)
        arcs.make_automaton()
        return arcs

    def _together(self, before: int, piece: int) -> bool:
        """Whether two neighbours are what merging gives for their joined text; at a border, whether the piece is for its own."""
        if len(self._pairs) >= _PAIRS:
            self._pairs.clear()
        texts = [self._texts[piece]] if before < 0 else [self._texts[before], self._texts[piece]]
        allowed = self._pairs[before * (len(self.scores) + 1) + piece] = self._merge("".join(texts)) == texts
        return allowed

    def _merge(self, text: str) -> list[str]:
        """What merging makes of a short text: of all neighbours that join to a piece, the best score first, the leftmost of equals."""
        symbols = list(text)
        while True:
            joins = [(-self.scores[n], k) for k in range(len(symbols) - 1) if (n := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
            if not joins:
                return symbols
            k = min(joins)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def compile_model(path: str) -> Transducer:
    """The transducer of a SentencePiece model file. Models whose normaliser has a character map of its own are refused."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("this model's normaliser is not supported")
    return Transducer([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, rules.add_dummy_prefix, rules.remove_extra_whitespaces)


def encoder(spark: SparkSession, transducer: Transducer):
    """A column function from texts to array<int> of piece ids; null stays null."""
    shared = spark.sparkContext.broadcast(transducer)  # the model, whatever the data

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in texts:
            found, offsets, total = [], [], 0
            for text in part:
                ids = own.encode(value) if (value := text.as_py()) is not None else None
                offsets.append(None if ids is None else total)
                if ids is not None:
                    found.append(np.array(ids, dtype=np.int32))
                    total += len(ids)
            values = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), pa.array(values, pa.int32()))

    return encode


def decoder(spark: SparkSession, transducer: Transducer):
    """A column function from arrays of piece ids to texts; null stays null."""
    shared = spark.sparkContext.broadcast(transducer)

    @F.arrow_udf("string")
    def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for part in lists:
            yield pa.array([None if (ids := value.as_py()) is None else own.decode(ids) for value in part], pa.string())

    return decode


def with_pieces(docs: DataFrame, path: str, text_col: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each text; null texts give null, empty ones an empty array. A column ``name`` is replaced."""
    return docs.withColumn(name, encoder(docs.sparkSession, compile_model(path))(F.col(f"`{text_col}`")))


def with_checked_pieces(docs: DataFrame, transducer: Transducer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_ids``, ``decoded_sha256`` and ``exact`` in place of the text, which is encoded and decoded in one pass.

    ``exact`` tells whether decoding gives the text with every mark as a space (and, for models that squeeze, single spaces). All four are
    null for a null text. Columns of those names are replaced.
    """
    added = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_ids", pa.int64()), pa.field("decoded_sha256", pa.string()), pa.field("exact", pa.bool_())]
    kept = [f for f in docs.schema.fields if f.name not in (text_col, *[x.name for x in added])]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids array<int>", "n_ids bigint", "decoded_sha256 string", "exact boolean"])
    names = [f.name for f in kept] + [x.name for x in added]
    shared = docs.sparkSession.sparkContext.broadcast(transducer)  # the model, whatever the data

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                coded, sizes, digests, exact = [], [], [], []
                for value in batch.column(batch.num_columns - 1):
                    text = value.as_py()
                    ids = None if text is None else own.encode(text)
                    read = None if ids is None else own.decode(ids)
                    coded.append(None if ids is None else np.array(ids, dtype=np.int32))
                    sizes.append(None if ids is None else len(ids))
                    digests.append(None if read is None else hashlib.sha256(read.encode("utf-8", "surrogatepass")).hexdigest())
                    exact.append(None if read is None else read == own.plain(text))
                columns = [pa.array(x, field.type) for x, field in zip((coded, sizes, digests, exact), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`")).mapInArrow(code, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, n_ids, decoded_sha256, exact) for every row: the encoding, and whether decoding it gives the normalised text.

    Null texts give nulls; repeated rows give equal rows; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return with_checked_pieces(rows, compile_model(path), text_col)
