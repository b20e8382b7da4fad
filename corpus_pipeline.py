"""The corpus pipeline: language ID, quality classifier, line dedup, near-dedup, packing.

Every stage works on all documents that the stage before it kept, and all but the last return the columns of
``documents``. Documents whose language is not recognised or whose quality score is under one half leave; repeated lines
leave; one document of each class of near-duplicates stays; what is left is packed into sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylane.llm import language_id, line_dedup, order_minhash, packing, quality_classifier
from quarrylane.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.dedup_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: The classifiers cannot be written in SQL; tests check every stage's columns and that what stays is distinct.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next one begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
