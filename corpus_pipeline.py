"""From raw documents to packed token sequences: quality, language, exact and near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm.common import stored
from spanlake.llm.exact_dedup import drop_duplicates
from spanlake.llm.language import keep_languages
from spanlake.llm.near_dedup import drop_near_duplicates
from spanlake.llm.packing import pack_documents
from spanlake.llm.quality_classifier import keep_good
from spanlake.llm.queries import WINDOW, WORD_MODEL, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough."""
    return keep_languages(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_duplicates(docs)


def distant_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, size=5, percent=80, bands=9)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of one window."""
    return pack_documents(docs, WORD_MODEL, WINDOW)


STAGES = [
    ("quality_classifier", good_documents),
    ("language_id", known_languages),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distant_texts),
    ("packing", packed),
]

#: Classifiers, MinHash links and packing can't be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
