"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` applies them to the documents table; a caller may as well write each
stage's result and read it as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm import bpe, jaccard, langid, linededup, mixing
from findrift.llm.common import fresh, table
from findrift.llm.queries import SEED, vocabulary

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _with_chars(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text; documents without the column stay so."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a determined language: null or letterless texts and ambiguous ones."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    lang, score, unsure = (fresh(c, docs.columns) for c in ("lang_pred", "score", "ambiguous"))
    found = langid.identify(docs, langid.train(docs), keep=keep, outputs=(lang, score, unsure))
    return found.where((F.col(lang) != langid.UNDETERMINED) & ~F.col(unsure)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of passages of 50 words or more; documents left without any text go."""
    removed = fresh("removed", docs.columns)
    done = linededup.dedup_lines(docs, removed_col=removed)
    left = done.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return _with_chars(left.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of near-duplicates: 0.8 or more of their five-word shingles in common.

    A SimHash multi-index proposes the pairs that are verified; an exact join finds those it cannot reach.
    """
    return jaccard.keep_one(docs, words=5, similarity=0.8).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources weigh as the square roots of their sizes."""
    return mixing.mix(docs, seed=SEED, copy_col=None).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.encode(docs, vocabulary(), keep=("doc_id", "source"), digests=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
