"""A training corpus from ``documents``: language, near-duplicates, personal data, source weights, token ids.

Every stage works on all rows that the stage before kept, and is written before the next one reads it. ``doc_id`` names a document;
a null id is a document like others. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import hamming_join, language, mixing, pii, sentencepieces
from tablemill.session import broadcast_if_small, stage

#: Score under which a language is taken as not identified. Documents without letters have score 0.
LEAST_SCORE = 0.5

#: Every document stays at least once; small sources are read up to a quarter more often than the largest.
MIX = mixing.Mix(max_repeats=1.25, cover=True, empty_sources=True)

PIECES = "piece_bpe_32k.model"

#: A fitted language model, expectation-maximisation and signatures are beyond SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; a missing label is filled in. Where the labels teach no language, all documents that have a letter stay as they are."""
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, lang_name="__lang", score_name="__score")
    kept = found.filter((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, null ids last. Of rows that repeat an id and a text one stays.

    A document is its id with its text, so neither null ids nor ids that stand at several texts are taken for one document.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("digest"))
    keyed = docs.withColumn("__key", key)
    groups = stage(hamming_join.near_groups(keyed, "__key"), "groups")
    gone = broadcast_if_small(groups.filter("not kept").select(F.col("__key").alias("__gone")).distinct())
    kept = keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    repeated = stage(groups.filter("kept").groupBy("__key").count().filter("count > 1").select(F.col("__key").alias("__repeated")), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    again = F.col("__key") == F.col("__repeated")
    return kept.join(repeated, again, "left_anti").union(kept.join(repeated, again, "left_semi").dropDuplicates(["__key"])).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources in part twice."""
    return mixing.realise(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, next to whether they decode to it: (doc_id, lang, source, n_chars, ids, n_ids, exact)."""
    transducer = sentencepieces.compile_model(public_tokenizers.path(PIECES))
    coded = sentencepieces.with_checked_pieces(docs.select("doc_id", "lang", "source", "n_chars", "text"), transducer)
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", "n_ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_weights", mix_sources),
    ("token_ids", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
