"""Language identification by known words first, then by ever shorter character n-grams.

Every word that the training documents use often enough votes with its log frequency in each language. An unknown word is
looked up by its character n-grams instead (with the word's borders marked): the longest length at which at least
one n-gram is known decides, and its known n-grams vote with their mean. A letter that no n-gram knows says nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import broadcast_if_small, stage

UNKNOWN = "und"

#: Labelled documents per language that the model is fitted on (a bound on the expected number, drawn by hash of the id).
FIT_DOCS = 2_000

#: Words and n-grams that a model keeps per language, the most frequent first, and the counts below which they are dropped.
FIT_WORDS, FIT_GRAMS, LEAST_COUNT = 20_000, 10_000, 2

LONGEST = 5

#: Words after which more evidence no longer sharpens the score.
EVIDENCE_WORDS = 50

_WORD = re.compile(r"[^\W\d_]+")
_LONG_TEXT = 1 << 20
_CACHED_WORDS, _WORDS_AT_ONCE = 200_000, 50_000


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def words(text: str) -> Iterable[str]:
    """Runs of letters in lower case; long texts are walked through and not listed."""
    text = text.lower()
    return _WORD.findall(text) if len(text) <= _LONG_TEXT else (m.group() for m in _WORD.finditer(text))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between border marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language, and predictions from them."""

    def __init__(self, languages: list[str], word_counts: dict[str, dict[str, int]], gram_counts: dict[str, dict[str, int]]):
        """Counts are by language, then by word or n-gram."""
        self.languages = sorted(languages)
        self.known = self._logs([word_counts.get(x, {}) for x in self.languages])
        by_length = [[{g: c for g, c in gram_counts.get(x, {}).items() if len(g) == n} for x in self.languages] for n in range(1, LONGEST + 1)]
        self.grams = [self._logs(counts) for counts in by_length]
        self._seen: dict[str, int] = {}
        self._votes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}, "_votes": None}

    @staticmethod
    def _logs(counts: list[dict[str, int]]) -> dict[str, np.ndarray]:
        """Add-half smoothed log frequencies, less their mean over the languages, so that an absent item weighs nothing."""
        items = set().union(*counts) if counts else set()
        totals = [sum(c.values()) + 0.5 * (len(items) + 1) for c in counts]
        table = {}
        for item in items:
            logs = np.array([math.log((c.get(item, 0) + 0.5) / total) for c, total in zip(counts, totals, strict=True)])
            table[item] = logs - logs.mean()
        return table

    def _total(self, words_: list[str], times: list[int]) -> np.ndarray:
        """Sum of the words' votes. Votes are remembered as rows of one matrix, which starts anew when it is full."""
        seen = self._seen
        if self._votes is None or len(seen) + len(words_) > _CACHED_WORDS:
            seen.clear()
            if self._votes is None:
                self._votes = np.empty((_CACHED_WORDS, len(self.languages)))
        votes = self._votes
        rows = [seen.get(word, -1) for word in words_]
        if -1 in rows:
            for n, row in enumerate(rows):
                if row < 0:
                    word = words_[n]
                    known = self.known.get(word)
                    rows[n] = seen[word] = len(seen)
                    votes[rows[n]] = self._backoff(word) if known is None else known
        return np.array(times, dtype=np.float64) @ votes[rows]

    def _backoff(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            table = self.grams[n - 1]
            hits = [table[g] for g in grams(word, n) if g in table]
            if hits:
                return sum(hits) / len(hits)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score. The score is the winner's posterior, as if a long text had ``EVIDENCE_WORDS`` words; equal votes go to the
        first language by name. (``und``, 0) without letters or without a trained language."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        counted = Counter(words(text))
        if not any(letter.isalpha() for word in counted for letter in word):
            return UNKNOWN, 0.0
        distinct, times = list(counted), list(counted.values())
        total = np.zeros(len(self.languages))
        for start in range(0, len(distinct), _WORDS_AT_ONCE):
            total += self._total(distinct[start : start + _WORDS_AT_ONCE], times[start : start + _WORDS_AT_ONCE])
        number = sum(times)
        total *= min(1.0, EVIDENCE_WORDS / number)
        weights = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(weights[best] / weights.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS,
        fit_words: int = FIT_WORDS, fit_grams: int = FIT_GRAMS) -> Model:
    """A model from the labelled documents that are not held out; null labels and null texts are left out.

    Of each language about ``fit_docs`` documents are used, drawn by the hash of id and text: a bounded training sample. Words and
    n-grams are counted by Spark, and the most frequent ones (``fit_words``, and ``fit_grams`` of each length) come to the driver.
    """
    # length counts the n-gram sizes; words are length 0
    named = docs.filter(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(id_col))
    named = named.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("at"))
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    limits = broadcast_if_small(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.col("n")).alias("share")))
    drawn = named.join(limits, "lang").filter((F.pmod(F.col("at"), F.lit(1 << 30)) + 1) / float(1 << 30) <= F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words(text))
            for lang, found in counts.items():
                pieces = Counter()
                for word, times in found.items():
                    for n in range(1, LONGEST + 1):
                        for gram in grams(word, n):
                            pieces[n, gram] += times
                pieces.update({(0, word): times for word, times in found.items()})
                keys = list(pieces)
                for start in range(0, len(keys), 10_000):
                    part = keys[start : start + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part]),
                                                      pa.array([pieces[k] for k in part], pa.int64())], ["lang", "length", "item", "n"])

    counted = drawn.mapInArrow(count, "lang string, length int, item string, n bigint").groupBy("lang", "length", "item").agg(F.sum("n").alias("n"))
    counted = stage(counted.filter(F.col("n") >= LEAST_COUNT), "items")
    tables: dict[bool, dict[str, dict[str, int]]] = {True: {}, False: {}}
    languages = sorted(row["lang"] for row in sizes.select("lang").collect())
    for lang in languages:
        for length in range(LONGEST + 1):
            limit = fit_words if length == 0 else fit_grams
            top = counted.filter((F.col("lang") == lang) & (F.col("length") == length)).orderBy(F.col("n").desc(), "item").limit(limit)
            tables[length == 0].setdefault(lang, {}).update({row["item"]: row["n"] for row in top.select("item", "n").collect()})
    return Model(languages, tables[True], tables[False])


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, from the text alone. Columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters

    @F.pandas_udf("lang string, score double")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in texts:
            yield pd.DataFrame([own.predict(text) for text in part], columns=["lang", "score"])

    # a filter on the result must not lead Spark to predict once for the filter and once more for the columns
    once = label.asNondeterministic()
    found = docs.drop(lang_name, score_name).withColumn("__language", once(F.col(f"`{text_col}`")))
    return found.withColumn(lang_name, F.col("__language.lang")).withColumn(score_name, F.col("__language.score")).drop("__language")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row of ``docs``, by a model fitted on those of its rows that are not held out.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learnt. Repeated rows are predicted alike; a row with a
    null id is not held out. An empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    done = predict(rows, model)
    return done.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
