"""Order MinHash fingerprints of texts, sensitive to edit distance: DataFrame functions only.

A text is cut into tokens: runs of at most 24 characters other than white space, and the single characters of longer runs. Every ``k`` tokens
in a row are a k-mer; one that begins inside a long run has twelve, so that texts without spaces have overlapping k-mers that are rare enough
and don't depend on where the run begins.
Repeated k-mers are told apart by their occurrence number. A hash of (k-mer, occurrence) deals each into one of ``cells``
cells and orders it there; the ``length`` smallest of a cell are put back in the order of the text, and the hash of that
tuple is the cell's part of the fingerprint. Texts that share k-mers in another order share few tuples, so the share of
equal cells follows the edit distance, where plain MinHash only sees sets.

All of it happens inside the row, in array functions: nothing is exploded or shuffled. Arrays that are used twice are columns
of their own, because Spark would otherwise compute them again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemill.session import stage

K, LENGTH, CELLS = 3, 2, 32

# Characters of a run of more than 24 get a mark in front.
_LONG, _IN_LONG, _MARK, _RUN_K = r"\S{25}", r"(?:(?<!\S)(?=\S{25})|\G(?<=\S))(\S)", "\x01", 12
_TOKEN = r"\x01\S|\S{1,24}"
#: A k-mer is one number: 35 bits of its hash above 28 bits of its position, so 268 million tokens have room in a text.
_POSITION_BITS = 28
_POSITION = (1 << _POSITION_BITS) - 1
_CELL_SHIFT = 32


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "fingerprint", k: int = K, length: int = LENGTH, cells: int = CELLS) -> DataFrame:
    """``df`` with an array<bigint> column ``name``: for each cell that has k-mers, (cell << 32) + hash of its tuple.

    Null, empty and blank texts have an empty fingerprint; a text of fewer than ``k`` tokens is one k-mer. ``cells`` is a power of
    two of at most 32. A column ``name`` that is already there is replaced.
    """
    if cells not in (1, 2, 4, 8, 16, 32) or k < 1 or length < 1:
        raise ValueError("cells has to be a power of two up to 32, k and length at least 1")
    cell_bits = cells.bit_length() - 1
    words, kmers, sorted_, dealt, kept = (f"__omh_{part}" for part in ("words", "kmers", "sorted", "dealt", "kept"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = F.when(text.rlike(_LONG), F.regexp_replace(text, F.lit(_IN_LONG), F.lit(f"{_MARK}$1"))).otherwise(text)
    df = df.drop(name).withColumn(words, F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0)))

    def kmer(word: Column, i: Column) -> Column:
        hashed = F.when(F.startswith(word, F.lit(_MARK)), F.xxhash64(F.slice(F.col(words), i + 1, _RUN_K))).otherwise(F.xxhash64(word, *[F.get(F.col(words), i + j) for j in range(1, k)]))
        return F.shiftleft(F.shiftrightunsigned(hashed, 29), _POSITION_BITS).bitwiseOR(i.cast("bigint"))

    found = F.slice(F.transform(F.col(words), kmer), F.lit(1), F.greatest(F.lit(1), F.size(words) - (k - 1)))
    df = df.withColumn(kmers, found).withColumn(sorted_, F.sort_array(kmers))

    def occurrence(x: Column, i: Column) -> Column:
        """How many equal k-mers stand before x in the sorted array, by doubling steps."""
        same = lambda distance: _kmer(F.get(F.col(sorted_), i - distance)) == _kmer(x)
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(_POSITION_BITS))])
        count = F.aggregate(steps, F.lit(0), lambda d, step: F.when(same(d + step), d + step).otherwise(d))
        return F.when(same(F.lit(1)), count).otherwise(F.lit(0))

    def deal(x: Column, i: Column) -> Column:
        hashed = F.xxhash64(_kmer(x), occurrence(x, i))
        return F.shiftleft(F.shiftrightunsigned(hashed, 64 - cell_bits - 30), _POSITION_BITS).bitwiseOR(x.bitwiseAND(F.lit(_POSITION)))

    cell = lambda x: F.shiftright(x, _POSITION_BITS + 30)
    df = df.withColumn(dealt, F.sort_array(F.transform(F.col(sorted_), deal)))
    least = F.filter(F.col(dealt), lambda x, i: F.coalesce(cell(F.get(F.col(dealt), i - length)) != cell(x), F.lit(True)))
    df = df.withColumn(kept, least)

    def tuple_hash(x: Column, i: Column) -> Column:
        mine = F.filter(F.slice(F.col(kept), i + 1, length), lambda y: cell(y) == cell(x))
        in_text = F.sort_array(F.transform(mine, lambda y: y.bitwiseAND(F.lit(_POSITION)).cast("int")))
        hashed = F.xxhash64(F.transform(in_text, lambda at: _kmer(F.get(F.col(kmers), at))))
        first = F.coalesce(cell(F.get(F.col(kept), i - 1)) != cell(x), F.lit(True))
        return F.when(first, F.shiftleft(cell(x), _CELL_SHIFT) + F.shiftrightunsigned(hashed, 32))

    return df.withColumn(name, F.filter(F.transform(F.col(kept), tuple_hash), lambda x: x.isNotNull())).drop(words, kmers, sorted_, dealt, kept)


def _kmer(packed: Column) -> Column:
    return F.shiftright(packed, _POSITION_BITS)


def likeness(one: Column, other: Column) -> Column:
    """Share of equal cells among the cells that either fingerprint has, 0 to 1; two empty fingerprints are alike."""
    cells = lambda x: F.transform(x, lambda y: F.shiftright(y, _CELL_SHIFT))
    either = F.size(F.array_union(cells(one), cells(other)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)) / either).cast("double")


def as_text(fingerprint: Column) -> Column:
    """The fingerprint as words of ten hexadecimal digits: two of the cell, eight of the tuple."""
    return F.concat_ws(" ", F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint next to that of an edited text and that of the next document.

    The next document has the next smaller id (after the smallest comes the largest; one document alone is its own next). The
    edited text is the document's with its last third (rounded down) replaced by as many leading characters of the next
    document, or all it has. One row per row of ``docs``: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Null texts count as empty. Rows that repeat id and text are one document with the same results; different texts
    under one id follow each other in the order of their hash; null ids come last. Only the two columns are read.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    source = source.withColumn("key", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "text"))))
    printed = with_fingerprint(source.withColumn("n_chars", F.length("text").cast("bigint"))).drop("text")
    unique = printed.groupBy("key").agg(*[F.first(c).alias(c) for c in ("id", "n_chars", "fingerprint")])
    nexts = _with_next(unique)
    texts = source.select("key", "text")
    heads = texts.join(nexts.select(F.col("next.key").alias("key"), F.col("key").alias("target"), F.floor(F.col("n_chars") / 3).cast("int").alias("taken")), "key")
    heads = heads.select("target", F.left("text", F.col("taken")).alias("head")).groupBy("target").agg(F.first("head").alias("head"))
    both = texts.join(nexts, "key").join(heads, F.col("key") == F.col("target"))
    left = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    edited = both.withColumn("edited", F.concat(F.left("text", left), "head")).drop("text", "head")
    edited = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    done = with_fingerprint(edited, "edited", "edited_fingerprint")
    return done.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("fingerprint")).alias("fingerprint"),
                       as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"))


def _with_next(unique: DataFrame) -> DataFrame:
    """``unique`` with a struct ``next`` (id, key, fingerprint) of the row that follows by falling id.

    Rows are cut into ranges of the id and written, so the ranges stay what they are; inside a range a window finds the
    next row, and one row per range tells where the range after it begins.
    """
    order = [F.col("id").desc_nulls_last(), F.col("key")]
    pieces = stage(unique.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "pieces")
    row = F.struct("id", "key", "fingerprint")
    inside = W.partitionBy("piece").orderBy(*order)
    ranked = pieces.withColumn("next", F.lead(row).over(inside)).withColumn("at", F.row_number().over(inside))
    starts = ranked.filter("at = 1").select("piece", row.alias("start"))
    by_piece = W.orderBy("piece")
    starts = starts.select("piece", F.coalesce(F.lead("start").over(by_piece), F.first("start").over(by_piece)).alias("after"))  # a row per range
    return stage(ranked.join(F.broadcast(starts), "piece").select("id", "key", "n_chars", "fingerprint", F.coalesce("next", "after").alias("next")), "nexts")
